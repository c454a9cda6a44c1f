"""Catalogue of the journal engine's queries and their SQL.

Every query runs over whole tables of the driver.  Queries that need a journal
write the table's messages into one in the shared folder first, then read,
verify and decode it; the SQL states the same result over the plain table.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import checksum, flatbuf
from tidemark.functions.flatbuf import Descriptor, Field
from tidemark.operators import ingest, observe, policy, recovery, validation
from tidemark.sources import journal
from tidemark.sources.codec import format_of, scan
from tidemark.sources.files import listing, locate, open_input, shared_uri
from tidemark.streaming import journals as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_written: dict[tuple, str] = {}

EVENT = Descriptor("Event", (Field("event_id", 4, "long"), Field("user_id", 6, "long"), Field("value", 8, "double"), Field("event_type", 10, "string"), Field("micros", 12, "long"), Field("props", 14, "string")))
#: Bytes of the string root of a text: offset, length, text, end mark, padding.
_ROOT_LEN = "(8 + 4 * CAST(ceil((octet_length(encode({0})) + 1) / 4.0) AS BIGINT))"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], **options) -> str:
    """The folder of a journal, written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *sorted(options.items()))
    if key not in _written:
        journal.register(spark)
        path = shared_uri(spark, name)
        make().select("payload").write.format("framed").options(**options).mode("append").save(path)
        _written[key] = path
    return _written[key]


def frames(spark: SparkSession, path: str, **options) -> DataFrame:
    return journal.register(spark).read.format("framed").options(**options).load(path)


def events_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return flatbuf.encode(rows, EVENT)


def event_journal(spark: SparkSession, sf_dir: str, **options) -> str:
    return written(spark, sf_dir, "events", lambda: events_payload(spark, sf_dir), **options)


def strings(spark: SparkSession, sf_dir: str, name: str, column: str, **options) -> str:
    """A journal of string roots."""
    return written(spark, sf_dir, f"{name}-{column}", lambda: flatbuf.encode(table(spark, sf_dir, name).where(F.col(column).isNotNull()), flatbuf.STRING, [column]), **options)


def decoded(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return flatbuf.decode(frames(spark, event_journal(spark, sf_dir, **options), **options), EVENT)


_BY_TYPE = "SELECT event_type, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most, avg(value) AS mean FROM events GROUP BY event_type"


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


# ---- scans and sinks -------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def scan_plain_typed(spark, sf_dir):
    return decoded(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "props")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def scan_crc32_by_type(spark, sf_dir):
    return decoded(spark, sf_dir, checksum="crc32").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def scan_crc16_by_type(spark, sf_dir):
    return decoded(spark, sf_dir, checksum="crc16").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def scan_xxh3_by_type(spark, sf_dir):
    return decoded(spark, sf_dir, checksum="xxh3").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"SELECT count(*) AS frames, sum({_ROOT_LEN.format('text')}) AS payload_bytes, max({_ROOT_LEN.format('text')}) AS longest FROM documents WHERE text IS NOT NULL")
def scan_headers_only(spark, sf_dir):
    path = strings(spark, sf_dir, "documents", "text")
    got = frames(spark, path, headerOnly="true")
    return got.agg(F.count(F.lit(1)).alias("frames"), F.sum("payload_len").cast("decimal(38,0)").alias("payload_bytes"), F.max("payload_len").alias("longest"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def scan_split_ranges(spark, sf_dir):
    """Journals, one of each part of the table, read in many ranges of whole frames; ids are in the payloads."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    both = lambda: flatbuf.encode(rows.withColumn("both", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"))), flatbuf.STRING, ["both"])
    got = flatbuf.decode(frames(spark, written(spark, sf_dir, "ranges", both), splitBytes="65536"), flatbuf.STRING)
    return got.select(F.substring_index("value", ":", 1).cast("bigint").alias("doc_id"), F.expr("substring(value, locate(':', value) + 1)").alias("text"))


@query(f"SELECT count(*) FILTER ({_ROOT_LEN.format('text')} <= 2048) AS within, count(*) FILTER ({_ROOT_LEN.format('text')} > 2048) AS beyond FROM documents WHERE text IS NOT NULL")
def bound_by_length(spark, sf_dir):
    got = frames(spark, strings(spark, sf_dir, "documents", "text"), headerOnly="true")
    return got.agg(F.count_if(F.col("payload_len") <= 2048).alias("within"), F.count_if(F.col("payload_len") > 2048).alias("beyond"))


@query("SELECT r_regionkey, r_name, CAST(octet_length(encode(r_name)) AS BIGINT) AS payload_len, CAST(4 + octet_length(encode(r_name)) AS BIGINT) AS frame_len FROM region")
def frame_as_expression(spark, sf_dir):
    """Frames built by the JVM alone: no Python between the table and the bytes."""
    payload = F.encode("r_name", "UTF-8")
    rows = table(spark, sf_dir, "region").withColumn("frame", checksum.framed(payload))
    return rows.select("r_regionkey", F.decode(F.expr("substring(frame, 5)"), "UTF-8").alias("r_name"), F.octet_length(payload).cast("bigint").alias("payload_len"), F.octet_length("frame").cast("bigint").alias("frame_len"))


@query("SELECT 'control' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'vector', count(*) FROM embeddings")
def mixed_journal(spark, sf_dir):
    """Several message types in one journal without tags; told apart by trial of their descriptors' sizes."""
    one = flatbuf.encode(table(spark, sf_dir, "nation").withColumn("m", F.concat(F.lit("control:"), "n_name")), flatbuf.STRING, ["m"])
    two = flatbuf.encode(table(spark, sf_dir, "region").withColumn("m", F.concat(F.lit("region:"), "r_name")), flatbuf.STRING, ["m"])
    three = flatbuf.encode(table(spark, sf_dir, "embeddings"), flatbuf.DOUBLES, ["embedding"])
    got = frames(spark, written(spark, sf_dir, "mixed", lambda: one.unionByName(two).unionByName(three), checksum="crc32"), checksum="crc32")
    text = flatbuf.decode(got.where("payload_len < 200"), flatbuf.STRING).select(F.substring_index("value", ":", 1).alias("kind"))
    vector = flatbuf.decode(got.where("payload_len >= 200"), flatbuf.DOUBLES).select(F.lit("vector").alias("kind"))
    return text.unionByName(vector).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- projection, filters, limits -------------------------------------------


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[2] AS DOUBLE) AS second, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def vector_root_columns(spark, sf_dir):
    """Columns taken out of a vector root by index."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("v"))
    got = flatbuf.decode(frames(spark, written(spark, sf_dir, "vectors", lambda: flatbuf.encode(rows, flatbuf.DOUBLES, ["v"]))), flatbuf.DOUBLES)
    return got.select(F.element_at("value", 1).cast("bigint").alias("vec_id"), F.element_at("value", 2).alias("first"), F.element_at("value", 3).alias("second"), (F.size("value") - 1).alias("n"))


@query("SELECT count(*) FILTER (value > 80) AS high, count(*) FILTER (value < 20) AS low, count(*) AS n FROM events")
def conditional_counts(spark, sf_dir):
    return decoded(spark, sf_dir).agg(F.count_if(F.col("value") > 80).alias("high"), F.count_if(F.col("value") < 20).alias("low"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 50 AND event_type <> 'view'")
def filter_by_field(spark, sf_dir):
    return decoded(spark, sf_dir).where((F.col("value") > 50) & (F.col("event_type") != "view")).select("event_id", "event_type", "value")


@query("WITH x AS (SELECT value, row_number() OVER (ORDER BY event_id) AS examined FROM events) SELECT value, examined FROM x WHERE value > 80 ORDER BY examined LIMIT 1")
def first_match(spark, sf_dir):
    """The first frame that matches, and how many were examined; journals follow each other in order of their names."""
    ordered = lambda: flatbuf.encode(table(spark, sf_dir, "events").withColumn("micros", F.lit(0)).orderBy(F.asc_nulls_last("event_id")), EVENT)
    got = flatbuf.decode(frames(spark, written(spark, sf_dir, "ordered", ordered)), EVENT, keep=("path", "frame_no"))
    each = got.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("value") > 80, F.struct("frame_no", "value"))).alias("first"))
    placed = each.withColumn("before", F.sum("n").over(Window.orderBy("path")) - F.col("n")).where("first is not null").orderBy("path").limit(1)
    return placed.select("first.value", (F.col("before") + F.col("first.frame_no") + 1).alias("examined"))


@query("SELECT event_id, octet_length(encode(event_type)) AS type_bytes FROM events")
def typed_with_payload(spark, sf_dir):
    got = flatbuf.decode(frames(spark, event_journal(spark, sf_dir)), EVENT, keep=("payload",))
    return got.where(F.octet_length("payload") > 0).select("event_id", F.octet_length("event_type").alias("type_bytes"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def encode_decode_orders(spark, sf_dir):
    what = Descriptor("Order", (Field("o_orderkey", 4, "ulong"), Field("o_custkey", 6, "uint"), Field("o_orderstatus", 8, "string"), Field("o_totalprice", 10, "double")))
    got = flatbuf.decode(flatbuf.encode(table(spark, sf_dir, "orders"), what), what)
    return got.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice")


# ---- integrity, validation, observation ------------------------------------


def _crc_sql(text: str) -> tuple[str, str]:
    """CRC-16 (a byte at a time) and CRC-32 (a bit at a time) of a text as DuckDB expressions."""
    first = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST(ord(substr({text}, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))"
    mixed = "xor((c >> 8) & 255, b)"
    folded = f"xor({mixed}, {mixed} >> 4)"
    crc16 = f"list_reduce(list_concat([0::BIGINT], {first}), lambda c, b: xor(xor(xor((c << 8) & 65535, ({folded} << 12) & 65535), ({folded} << 5) & 65535), {folded}))"
    bits = f"list_transform(range(8 * octet_length(encode({text}))), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ord(substr({text}, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE 0::BIGINT END)"
    crc32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT)"
    return crc16, crc32


@query("SELECT event_id, {} AS crc16, {} AS crc32 FROM (SELECT event_id, event_type || ':' || event_id AS s FROM events)".format(*_crc_sql("s")))
def checksum_columns(spark, sf_dir):
    """Checksums of a text by value; CRC-32 in the JVM."""
    payload = F.encode(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), "UTF-8")
    return table(spark, sf_dir, "events").select("event_id", *[checksum.checksum(payload, c).cast("bigint").alias(c) for c in ("crc16", "crc32")])


@query()
def checksum_xxh3(spark, sf_dir):
    """XXH3-64, which SQL lacks; known answers are in the tests."""
    payload = F.encode(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), "UTF-8")
    return table(spark, sf_dir, "events").select("event_id", checksum.checksum(payload, "xxh3").alias("xxh3"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def telemetry_stats(spark, sf_dir):
    rows = by_type(decoded(spark, sf_dir, checksum="xxh3"))
    return rows.select("event_type", "n", F.round("total", 3).alias("total"), F.round("mean", 6).alias("mean"))


def _in_line(got: DataFrame, name: str = "none") -> DataFrame:
    """Frames whose numbers and offsets run on from journal to journal."""
    each = got.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("offset") + F.col("payload_len") + checksum.overhead(name)).alias("wire"))
    before = [(F.sum(c).over(Window.orderBy("path")) - F.col(c)).alias(f"{c}_before") for c in ("n", "wire")]
    out = got.join(F.broadcast(each.select("path", *before)), "path")
    return out.withColumns({"frame_no": F.col("frame_no") + F.col("n_before"), "offset": F.col("offset") + F.col("wire_before")})


@query("SELECT c_custkey, CAST(octet_length(encode(c_name)) AS BIGINT) AS payload_len, CAST(sum(8 + octet_length(encode(c_name))) OVER (ORDER BY c_custkey) - 8 - octet_length(encode(c_name)) AS BIGINT) AS frame_offset FROM customer")
def frame_layout(spark, sf_dir):
    """Where each frame begins, and how long it is; journals follow each other in order of their names, as do those of the keys."""
    rows = table(spark, sf_dir, "customer").orderBy(F.asc_nulls_last("c_custkey"))
    text = lambda c: lambda: rows.select(F.encode(c, "UTF-8").alias("payload"))
    got = _in_line(frames(spark, written(spark, sf_dir, "layout", text(F.col("c_name")), checksum="crc32"), checksum="crc32", headerOnly="true"), "crc32")
    keys = _in_line(frames(spark, written(spark, sf_dir, "layout-keys", text(F.col("c_custkey").cast("string")))))
    keys = keys.select("frame_no", F.decode("payload", "UTF-8").cast(rows.schema["c_custkey"].dataType).alias("c_custkey"))
    return got.join(keys, "frame_no").select("c_custkey", "payload_len", F.col("offset").alias("frame_offset"))


@query("SELECT doc_id, 'InvalidFrame' AS kind, CAST(octet_length(encode(text)) AS BIGINT) AS declared_len FROM documents WHERE octet_length(encode(text)) > 2048")
def bounded_reject(spark, sf_dir):
    """Payloads that a bounded sink refuses before it writes a byte."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    got = validation.validate(rows, validation.bound(2048), mode="permissive").where("error is not null")
    return got.select("doc_id", F.col("error.kind").alias("kind"), F.col("error.declared_len").alias("declared_len"))


def raw_journal(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], **options) -> str:
    """The folder of journals made of the ``frame`` column's bytes as they are, faults included, with the index of long ones."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = shared_uri(spark, name)

        def run(batches):
            from pyspark import TaskContext

            task = TaskContext.get()
            where, folder = locate(path)
            where.create_dir(folder, recursive=True)
            temp = f"{folder}/_{task.partitionId()}.{task.taskAttemptId()}"
            with where.open_output_stream(temp, compression=None) as f:
                for batch in batches:
                    f.write(b"".join(batch.column(0).to_pylist()))
            where.move(temp, f"{folder}/journal-{task.partitionId():05d}.journal")
            yield from ()

        make().select("frame").mapInArrow(run, "n bigint").count()
        journal.build_index(spark, path, **options)
        _written[key] = path
    return _written[key]


@query("SELECT count(*) FILTER (event_id % 7 = 0) AS broken, count(*) FILTER (event_id % 7 <> 0) AS sound, CAST(sum(event_id) FILTER (event_id % 7 <> 0) AS BIGINT) AS ids, max(value) FILTER (event_id % 7 <> 0) AS most FROM events")
def corruption_detected(spark, sf_dir):
    """A byte of every seventh frame is another one: these fail, the others are read."""

    def make():
        rows = table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
        framed = flatbuf.encode(rows, EVENT, keep=("event_id",)).select("event_id", checksum.framed("payload", "crc32").alias("frame"))
        last = F.conv(F.hex(F.substring("frame", -1, 1)), 16, 10).cast("int")
        other = F.unhex(F.lpad(F.hex(255 - last), 2, "0"))
        spoilt = F.concat(F.expr("substring(frame, 1, octet_length(frame) - 1)"), other)
        return framed.select(F.when(F.col("event_id") % 7 == 0, spoilt).otherwise(F.col("frame")).alias("frame"))

    got = frames(spark, raw_journal(spark, sf_dir, "spoilt", make, checksum="crc32"), checksum="crc32", mode="permissive")
    broken = got.where("error is not null").agg(F.count_if(F.col("error.kind") == "ChecksumMismatch").alias("broken"))
    sound = flatbuf.decode(got.where("error is null"), EVENT).agg(F.count(F.lit(1)).alias("sound"), F.sum("event_id").alias("ids"), F.max("value").alias("most"))
    return broken.withColumn("one", F.lit(1)).join(sound.withColumn("one", F.lit(1)), "one").drop("one")


@query("SELECT c_custkey, CAST(octet_length(encode(c_name)) AS BIGINT) AS payload_len, left(c_name, length(c_name) - 4) AS rest, 'UnexpectedEof' AS failure FROM customer")
def misframe(spark, sf_dir):
    """A plain reader on a checksummed journal of one message: the right length, wrong bytes, then a failure."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", checksum.framed(F.encode("c_name", "UTF-8"), "crc32").alias("frame"))

    def run(batches):
        import io

        form = format_of("none")
        for batch in batches:
            out = []
            for key, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = [*scan(io.BytesIO(frame), form)]
                payload = got[0].payloads[0].as_py()
                out.append({"c_custkey": key, "payload_len": len(payload), "rest": payload[4:].decode(), "failure": got[-1].failure.kind})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("c_custkey", pa.int64()), ("payload_len", pa.int64()), ("rest", pa.string()), ("failure", pa.string())]))

    return rows.mapInArrow(run, "c_custkey bigint, payload_len bigint, rest string, failure string")


@query("SELECT checksum, payloads, CAST(overhead AS BIGINT) AS overhead_bytes, CAST(overhead AS DOUBLE) / payloads AS mean_overhead FROM (SELECT c.checksum, count(*) AS payloads, count(*) * c.width AS overhead FROM events, (VALUES ('none', 4), ('crc16', 6), ('crc32', 8), ('xxh3', 12)) c(checksum, width) GROUP BY c.checksum, c.width)")
def checksum_overhead(spark, sf_dir):
    """Header bytes of each strategy: the next frame's offset less the payload's end."""
    out = None
    for name in ("none", "crc16", "crc32", "xxh3"):
        got = frames(spark, event_journal(spark, sf_dir, checksum=name), checksum=name, headerOnly="true")
        wire = got.groupBy("path").agg(F.max(F.col("offset") + F.col("payload_len") + checksum.overhead(name)).alias("wire"), F.sum("payload_len").alias("bytes"), F.count(F.lit(1)).alias("n"))
        row = wire.agg(F.lit(name).alias("checksum"), F.sum("n").alias("payloads"), F.sum(F.col("wire") - F.col("bytes")).alias("overhead_bytes"))
        row = row.withColumn("mean_overhead", F.col("overhead_bytes") / F.col("payloads"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT count(*) FILTER (n < 256) AS small, count(*) FILTER (n BETWEEN 256 AND 4096) AS fine, count(*) FILTER (n > 4096) AS large FROM (SELECT {_ROOT_LEN.format('text')} AS n FROM documents WHERE text IS NOT NULL)")
def size_validation(spark, sf_dir):
    got = frames(spark, strings(spark, sf_dir, "documents", "text"))
    checked = validation.validate(got, validation.composite(validation.none(), validation.size(256, 4096)), mode="permissive")
    bad = F.col("error.validator") == "SizeValidator"
    return checked.agg(F.count_if(bad & (F.col("payload_len") < 256)).alias("small"), F.count_if(F.col("error").isNull()).alias("fine"), F.count_if(bad & (F.col("payload_len") > 4096)).alias("large"))


@query("SELECT 'TypedValidator' AS validator, count(*) AS n FROM nation UNION ALL SELECT 'sound', count(*) FROM events")
def composite_validation(spark, sf_dir):
    """First failure wins: text payloads fail, event tables pass."""
    names = table(spark, sf_dir, "nation").select(F.encode(F.concat(F.lit("~~~~"), "n_name"), "UTF-8").alias("payload"))
    both = events_payload(spark, sf_dir).unionByName(names)
    checked = validation.validate(both, validation.composite(validation.size(1), validation.typed(EVENT), validation.table_root()), mode="permissive")
    return checked.groupBy(F.coalesce("error.validator", F.lit("sound")).alias("validator")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS messages, count(*) AS seen FROM events")
def observed_scan(spark, sf_dir):
    """Counts taken while rows pass agree with the rows."""
    stages = observe.Stages(frames(spark, event_journal(spark, sf_dir))).bounded(1 << 20).observed("scan")
    n = stages.df.agg(F.count("payload").alias("messages")).collect()[0].messages
    return spark.createDataFrame([(n, stages.observations["scan"].get["messages"])], "messages bigint, seen bigint")


# ---- aggregation ------------------------------------------------------------


@query(f"SELECT event_type, count(*) AS messages, sum(octet_length(encode(event_type))) AS text_bytes, max(value) AS most FROM events GROUP BY event_type")
def per_stream_counts(spark, sf_dir):
    return decoded(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("event_type")).cast("decimal(38,0)").alias("text_bytes"), F.max("value").alias("most"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def windowed_statistics(spark, sf_dir):
    rows = decoded(spark, sf_dir).withColumn("ts", F.timestamp_micros("micros"))
    return streaming.windowed(rows, "ts", "value", "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "least", "most")


# ---- ingestion ----------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as message rows of their customer, and their prices as a wide order book of one level and a rest."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (number - 1).cast("bigint").alias("line_no"))
    text = lambda *c: F.array(*[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in c])
    base = F.col("o_custkey").cast("string").alias("base")
    message = rows.select(base, F.lit("message").alias("kind"), "line_no", text((F.col("line_no") + 1) * 0.5, F.lit(1), "o_orderkey", F.lit(5), "o_custkey", F.lit(-1)).alias("cells"))
    book = rows.select(base, F.lit("orderbook").alias("kind"), "line_no", text("o_orderkey", F.lit(5), "o_custkey", F.lit(7), F.lit(99)).alias("cells"))
    return message.unionByName(book)


_ROWS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS line_no FROM orders)"


@query(f"SELECT o_custkey, line_no, (line_no + 1) * CAST(0.5 AS DOUBLE) AS timestamp, CAST(1 AS INTEGER) AS levels, o_orderkey AS ask_price, o_custkey AS bid_price FROM {_ROWS}")
def paired_ingest(spark, sf_dir):
    """Snapshot k has the time of message k; wide rows become nested levels; odd cells are ignored."""
    lines = _lines(spark, sf_dir)
    got = ingest.pair(ingest.messages(lines), ingest.snapshots(lines))
    return got.select(F.col("base").cast("bigint").alias("o_custkey"), "line_no", "timestamp", F.size("asks").alias("levels"), F.col("asks")[0]["price"].alias("ask_price"), F.col("bids")[0]["price"].alias("bid_price"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS base, count(*) AS messages, count(*) AS orderbook FROM orders GROUP BY o_custkey")
def ingest_counts(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return ingest.counts(ingest.pair(ingest.messages(lines), ingest.snapshots(lines)))


@query("SELECT CAST(count(*) AS BIGINT) AS lone FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 0)")
def missing_pair(spark, sf_dir):
    """Bases without an order book: here the order books of even customers are taken away."""
    lines = _lines(spark, sf_dir).where((F.col("kind") == "message") | (F.col("base").cast("bigint") % 2 != 0))
    return ingest.missing_pairs(lines).agg(F.count(F.lit(1)).alias("lone"))


@query(f"SELECT count(*) AS n, count(*) FILTER (line_no = 0) AS timed FROM {_ROWS}")
def lenient_pairing(spark, sf_dir):
    """Snapshots without a message have time 0.0: here only first rows have messages."""
    lines = _lines(spark, sf_dir)
    got = ingest.pair_lenient(ingest.messages(lines).where("line_no = 0"), ingest.snapshots(lines))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("timestamp") > 0).alias("timed"))


# ---- policies, recovery, streaming -------------------------------------------


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select(F.col("source").alias("path"), F.col("doc_id").alias("frame_no"), F.octet_length("text").cast("bigint").alias("payload_len"))


@query("""
    WITH d AS (SELECT source AS path, doc_id AS frame_no, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
    a AS (SELECT *, count(*) FILTER (n > 4096) OVER (PARTITION BY path ORDER BY frame_no) AS arm FROM d),
    b AS (SELECT *, count(*) FILTER (n >= 2048) OVER (PARTITION BY path, arm ORDER BY frame_no) AS run FROM a WHERE arm > 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY path, arm, run ORDER BY frame_no) AS k FROM b WHERE n < 2048),
    e AS (SELECT *, row_number() OVER (PARTITION BY path, arm ORDER BY frame_no) AS nth FROM c WHERE k = 2)
    SELECT path, frame_no, 'SizeThreshold' AS reason, CAST(n AS BIGINT) AS last_message_size FROM e WHERE nth = 1
""")
def policy_size_threshold(spark, sf_dir):
    """The fold, whose events window functions and SQL give as well (baseline 0: the gate is open)."""
    got = policy.replay(_sizes(spark, sf_dir), lambda: policy.SizeThreshold(4096, 2048, 2, baseline=0))
    return got.select("path", "frame_no", "reason", "last_message_size")


@query(_SQL["policy_size_threshold"])
def policy_size_threshold_windows(spark, sf_dir):
    return policy.size_threshold_events(_sizes(spark, sf_dir), 4096, 2048, 2)


def _adaptive_sql(reader: bool) -> str:
    """The gate and the policy (ratio 4, wait 3, baseline 1024) as a recursion over the frames of each path."""
    start = "CASE WHEN s.pending THEN 1024 ELSE s.cap END"
    return f"""
        WITH RECURSIVE d AS (SELECT source AS path, doc_id AS frame_no, CAST(octet_length(encode(text)) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
        s AS (
            SELECT path, 0::BIGINT AS k, NULL::BIGINT AS frame_no, 0::BIGINT AS n, 0::BIGINT AS before, 1024::BIGINT AS cap, 0::BIGINT AS run, false AS pending, false AS fired FROM (SELECT DISTINCT path FROM d)
            UNION ALL
            SELECT path, k, frame_no, n, c, CASE WHEN fired AND {"false" if reader else "true"} THEN 1024 ELSE c END, CASE WHEN fired THEN 0 ELSE run END, fired AND {"true" if reader else "false"}, fired
            FROM (SELECT *, c > 1024 AND run >= 3 AS fired FROM (
                SELECT d.path, d.k, d.frame_no, d.n, greatest({start}, d.n) AS c,
                    CASE WHEN greatest({start}, d.n) <= 1024 THEN s.run WHEN d.n > 0 AND greatest({start}, d.n) >= 4 * d.n THEN s.run + 1 ELSE 0 END AS run
                FROM s JOIN d ON d.path IS NOT DISTINCT FROM s.path AND d.k = s.k + 1) x) y
        )
        SELECT path, frame_no, 'MessageCount' AS reason, n AS last_message_size, before AS capacity_before, 1024::BIGINT AS capacity_after FROM s WHERE fired"""


@query(_adaptive_sql(False))
def policy_adaptive_writer(spark, sf_dir):
    return policy.replay(_sizes(spark, sf_dir), lambda: policy.Adaptive(4, 3, baseline=1024))


@query(_adaptive_sql(True))
def policy_adaptive_reader(spark, sf_dir):
    return policy.replay(_sizes(spark, sf_dir), lambda: policy.Adaptive(4, 3, baseline=1024), side="reader")


@query("SELECT CAST(count(*) AS HUGEINT) AS frames, CAST(0 AS HUGEINT) AS torn, CAST(0 AS HUGEINT) AS broken FROM events")
def recovery_report(spark, sf_dir):
    got = recovery.recover(spark, event_journal(spark, sf_dir, checksum="crc32"), "crc32")
    return got.agg(F.sum("frames").cast("decimal(38,0)").alias("frames"), F.sum((F.col("end") == "TornTail").cast("int")).cast("decimal(38,0)").alias("torn"), F.sum(F.col("error").isNotNull().cast("int")).cast("decimal(38,0)").alias("broken"))


@query("""
    WITH b AS (SELECT sum(8 + octet_length(encode(n_name))) OVER (ORDER BY n_nationkey) AS upto FROM nation)
    SELECT c.cut, count(*) FILTER (b.upto <= c.cut) AS frames, CAST(coalesce(max(b.upto) FILTER (b.upto <= c.cut), 0) AS BIGINT) AS last_good_offset,
        CASE WHEN c.cut = 0 OR bool_or(b.upto = c.cut) THEN 'CleanEof' ELSE 'TornTail' END AS ending
    FROM (SELECT unnest(range(CAST((SELECT max(upto) FROM b) AS BIGINT) + 1)) AS cut) c, b GROUP BY c.cut
""")
def recover_sweep(spark, sf_dir):
    """A journal cut at every byte: what recovery finds of each piece."""
    rows = lambda: table(spark, sf_dir, "nation").repartition(1).sortWithinPartitions("n_nationkey").select(F.encode("n_name", "UTF-8").alias("payload"))
    ((path, size),) = listing(written(spark, sf_dir, "sweep", rows, checksum="crc32"))

    def run(batches):
        import io

        with open_input(path) as f:
            data = f.read()
        for batch in batches:
            found = [recovery.recover_stream(io.BytesIO(data[:k]), format_of("crc32")) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*found, strict=True))], ["cut", "frames", "last_good_offset", "ending"])

    return spark.range(size + 1).select(F.col("id").alias("cut")).mapInArrow(run, "cut bigint, frames bigint, last_good_offset bigint, ending string")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def stream_by_type(spark, sf_dir):
    """The same journal as a stream: all files that have arrived, then the end."""
    rows = flatbuf.decode(streaming.stream(spark, event_journal(spark, sf_dir, checksum="crc32"), checksum="crc32"), EVENT)
    name = f"by_type_{abs(hash(sf_dir))}"
    run = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_uri(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream to a checksummed journal, verified, decoded, aggregated."""
    return by_type(decoded(spark, sf_dir, checksum="xxh3"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
