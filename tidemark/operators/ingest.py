"""Paired CSV to journal ingestion.

Messages and order-book rows are paired by position within each base: numbers
come from the reader of each file, never from Spark's own ids.  Unequal lengths
and lone files are errors.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import flatbuf
from tidemark.sources.codec import format_of
from tidemark.sources.files import listing, locate, open_input, publish

#: Fixed value: the size-0 price of an empty level.
EMPTY_LEVEL = 9_999_999_999
LINES = "base string, kind string, line_no bigint, cells array<string>"


def verified_archives(spark: SparkSession, path: str, manifest: dict[str, str]) -> DataFrame:
    """(path, sha256, ok, skipped) of the ZIPs below ``path``, sorted: ``ok`` where the
    manifest (name -> SHA-256) lists them with this sum, else ``skipped`` says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                sha = hashlib.sha256()
                with open_input(name) as f:
                    while part := f.read(8 << 20):
                        sha.update(part)
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["path", "sha256"])

    files = [(p,) for p, _ in listing(path) if p.endswith(".zip")]
    names = spark.createDataFrame(files, "path string").repartition(max(1, len(files)))
    listed = spark.createDataFrame([*manifest.items()], "name string, expected string")
    found = names.mapInArrow(run, "path string, sha256 string").withColumn("name", F.substring_index("path", "/", -1)).join(listed, "name", "left")
    ok = F.coalesce(F.col("sha256") == F.lower("expected"), F.lit(False))
    why = F.when(F.col("expected").isNull(), F.concat("name", F.lit(" is not listed"))).when(~ok, F.concat("name", F.lit(" differs from its listed sum")))
    return found.select("path", "sha256", ok.alias("ok"), why.alias("skipped")).orderBy("path")


def csv_lines(archives: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Numbered rows of the first entry of each kind in each archive (column
    ``path``); ``kinds`` gives each kind the text that its entry's name has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in LINES.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                base = path.rsplit("/", 1)[-1].removesuffix(".zip")
                with open_input(path) as f, zipfile.ZipFile(f) as z:
                    for kind, part in kinds.items():
                        entry = next((n for n in z.namelist() if part in n and n.endswith(".csv")), None)
                        if entry is None:
                            continue
                        rows = []
                        with z.open(entry) as raw:
                            for k, cells in enumerate(csv.reader(io.TextIOWrapper(raw, "utf-8"))):
                                rows.append((base, kind, k, cells))
                                if len(rows) == 4096:
                                    yield give(rows)
                                    rows = []
                        if rows:
                            yield give(rows)

    return archives.select("path").mapInArrow(run, LINES)


def messages(lines: DataFrame) -> DataFrame:
    """Typed message rows; a missing field or a bad number raises."""
    cell = lambda k, t: F.element_at("cells", k + 1).cast(t)
    rows = lines.where(F.col("kind") == "message")
    short = F.when(F.size("cells") < 6, F.raise_error(F.concat(F.lit("message row "), F.col("line_no").cast("string"), F.lit(" has too few fields"))).cast("double"))
    return rows.select("base", "line_no", F.coalesce(short, cell(0, "double")).alias("timestamp"), cell(1, "smallint").alias("event_type"), cell(2, "decimal(20,0)").alias("order_id"), cell(3, "bigint").alias("size"), cell(4, "bigint").alias("price"), cell(5, "tinyint").alias("direction"))


def snapshots(lines: DataFrame) -> DataFrame:
    """Wide to nested: ask price, ask size, bid price, bid size for each level; fewer than four last cells are ignored."""
    rows = lines.where(F.col("kind") == "orderbook")
    levels = F.sequence(F.lit(0), F.floor(F.size("cells") / 4).cast("int") - 1)
    levels = F.when(F.size("cells") >= 4, levels).otherwise(F.array().cast("array<int>"))
    side = lambda shift: F.transform(levels, lambda k: F.struct(F.element_at("cells", k * 4 + 1 + shift).cast("bigint").alias("price"), F.element_at("cells", k * 4 + 2 + shift).cast("decimal(20,0)").alias("size")))
    return rows.select("base", "line_no", side(0).alias("asks"), side(2).alias("bids"))


def pair(msgs: DataFrame, books: DataFrame) -> DataFrame:
    """Snapshot k with the timestamp of message k; raises on unequal lengths."""
    both = msgs.withColumn("m", F.lit(True)).join(books.withColumn("o", F.lit(True)), ["base", "line_no"], "full_outer")
    fault = F.when(F.col("m").isNull() | F.col("o").isNull(), F.raise_error(F.concat(F.lit("LengthMismatch in "), F.col("base"), F.lit(" at row "), F.col("line_no").cast("string"))).cast("double"))
    return both.withColumn("timestamp", F.coalesce(fault, F.col("timestamp"))).drop("m", "o")


def pair_lenient(msgs: DataFrame, books: DataFrame) -> DataFrame:
    """Snapshots with the timestamp of their message, or 0.0 where there is none."""
    times = msgs.select("base", "line_no", F.col("timestamp").alias("t"))
    return books.join(times, ["base", "line_no"], "left").select("base", "line_no", F.coalesce("t", F.lit(0.0)).alias("timestamp"), "asks", "bids")


def missing_pairs(lines: DataFrame) -> DataFrame:
    """Bases of which only one kind has rows."""
    return lines.groupBy("base").agg(F.collect_set("kind").alias("kinds")).where(F.size("kinds") == 1)


def require_pairs(lines: DataFrame) -> DataFrame:
    """``lines``, raising MissingPair where a base has rows of one kind only.  The
    bases are told by a map-side aggregate; rows follow by a join on the base."""
    lone = missing_pairs(lines).select("base", F.element_at("kinds", 1).alias("only"))
    said = F.concat(F.lit("MissingPair: "), F.col("base"), F.lit(" has only "), F.col("only"))
    both = lines.join(lone, "base", "left")
    return both.withColumn("kind", F.when(F.col("only").isNotNull(), F.raise_error(said).cast("string")).otherwise(F.col("kind"))).drop("only")


def counts(paired: DataFrame) -> DataFrame:
    """The sidecar's counts for each base."""
    return paired.groupBy("base").agg(F.count("event_type").alias("messages"), F.count("asks").alias("orderbook"))


def journals(paired: DataFrame, out: str, checksum: str = "none") -> None:
    """Two journals for each base, in row order, ``out/<base>/message`` and
    ``.../orderbook``, with the counts of their rows in ``out/<base>/counts.txt``.
    One job for each kind writes all bases; a file has its name once it is whole."""
    form = format_of(checksum)

    def writer(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: list[tuple] = []
            now, sink, n, temp = None, None, 0, ""

            def close():
                if sink is not None:
                    sink.close()
                    where, name = locate(f"{out}/{now}/{kind}/journal-0.journal")
                    where.move(temp, name)
                    done.append((now, n))

            for batch in batches:
                bases = batch.column(0).to_pylist()
                edges = [0, *(k for k in range(1, len(bases)) if bases[k] != bases[k - 1]), len(bases)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if sink is None or bases[a] != now:
                        close()
                        now, n = bases[a], 0
                        where, folder = locate(f"{out}/{now}/{kind}")
                        where.create_dir(folder, recursive=True)
                        temp = f"{folder}/_{uuid.uuid4().hex}"
                        sink = where.open_output_stream(temp, compression=None)
                    sink.write(form.encode(batch.column(1).slice(a, b - a)))
                    n += b - a
            close()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["base", "n"])

        return run

    dealt = paired.repartition("base").sortWithinPartitions("base", "line_no")
    wrote = None
    for kind, what in (("message", flatbuf.MESSAGE), ("orderbook", flatbuf.ORDER_BOOK)):
        # what Python stages give keeps its order within a partition
        got = flatbuf.encode(dealt, what, keep=("base",)).mapInArrow(writer(kind), "base string, n bigint").withColumnRenamed("n", kind)
        wrote = got if wrote is None else wrote.join(got, "base")

    def sidecar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, m, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                publish(f"{out}/{base}/counts.txt", f"messages: {m}\norderbook: {o}\n".encode())
            yield batch.select([0])

    wrote.select("base", "message", "orderbook").mapInArrow(sidecar, "base string").count()


def is_halt(event_type: Column, price: Column) -> Column:
    """Trading halts: type 7 with price -1, 0 or 1."""
    return (event_type == 7) & price.isin(-1, 0, 1)


def real_levels(levels: Column) -> Column:
    """Levels without the empty ones."""
    return F.filter(levels, lambda x: ~((F.abs(x["price"]) == EMPTY_LEVEL) & (x["size"] == Decimal(0))))
