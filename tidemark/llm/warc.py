"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by id into shards whose bounds follow from the data
alone; each shard's files are rolled by compressed size; headers and digests
are generated anew from the payload; a file appears under its final name only
when it is whole, and only files in the manifest count.  The same table gives
the same files, on any cluster and after any retry.

Of records with equal payloads of at least ``revisit_from`` bytes, that with
the largest id is a response and the others revisit it.  Only the short list
of revisits is joined to the pages; Spark broadcasts it if its size allows.

Defined cases: a null payload is empty; a null url is left out; rows equal in
id and payload are one response and revisits of it; control characters in a
url are percent-encoded; an empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, shared_uri, small_batches

#: Payload bytes of a shard, about; compressed bytes after which a file is rolled.
SHARD_BYTES, ROLL_BYTES = 16 << 20, 64 << 20
#: Shards at most, which grow beyond; bounds are taken from about so many ids, or so many for each shard.
MOST_SHARDS, BOUND_IDS, IDS_FOR_EACH = 50_000, 20_000, 16
LEVEL = 3
#: The archive must not depend on when it is written.
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "file string, records bigint, bytes bigint, sha256 string"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    block = _HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _bounds(pages: DataFrame) -> np.ndarray:
    """Smallest ids of the shards but the first."""
    total = pages.agg(F.count("page_id").alias("n"), F.sum(F.length("payload")).alias("b")).first()
    if not total.n:
        return np.zeros(0, np.int64)
    shards = int(min(-(-(total.b or 0) // SHARD_BYTES), MOST_SHARDS))
    if shards < 2:
        return np.zeros(0, np.int64)
    hashed = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000_007))
    some = pages.where(F.col("page_id").isNotNull() & (hashed < min(1.0, max(BOUND_IDS, IDS_FOR_EACH * shards) / total.n) * 1_000_000_007)).select("page_id")
    ids = np.sort(some.toArrow().column(0).to_numpy())
    shards = min(shards, len(ids))
    return np.unique(ids[(np.arange(1, shards) * len(ids)) // shards]) if shards > 1 else np.zeros(0, np.int64)


def write_archive(df: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive below ``out``; gives its manifest (also at ``out/manifest``)."""
    pages = small_batches(df).select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    bounds = _bounds(pages)
    known = pages.where(F.length("payload") >= revisit_from).select("page_id", F.sha1("payload").alias("same"))
    first = known.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = known.join(first, "same").where("page_id < refers_to").select("page_id", F.col("same").alias("same_as"), "refers_to").distinct()
    revisits = materialize(revisits, "revisits")

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right").astype(np.int32))

    dealt = pages.withColumn("shard", shard_of("page_id")).repartitionById(len(bounds) + 1, F.col("shard"))
    dealt = dealt.withColumn("same", F.sha1("payload"))
    dealt = dealt.join(revisits.withColumnRenamed("page_id", "id"), (F.col("page_id") == F.col("id")) & (F.col("same") == F.col("same_as")), "left").sortWithinPartitions("shard", "page_id", "same", "url")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches):
        where, root = fs.FileSystem.from_uri(out)
        where.create_dir(f"{root}/temporary", recursive=True)
        done: list[tuple] = []
        now = last = sink = None
        part = records = size = 0
        sha = temp = None

        def close():
            nonlocal sink, part
            if sink is None:
                return
            sink.close()
            sink, name = None, f"shard-{now:06d}-{part:04d}.warc.gz"
            there = where.get_file_info(f"{root}/{name}")
            if there.type != fs.FileType.NotFound and there.size == size:
                where.delete_file(temp)  # an earlier attempt has left the same bytes
            else:
                where.move(temp, f"{root}/{name}")
            done.append((name, records, size, sha.hexdigest()))
            part += 1

        for batch in batches:
            for shard, page, url, payload, same, refers in zip(*(batch.column(k).to_pylist() for k in ("shard", "page_id", "url", "payload", "same", "refers_to")), strict=True):
                if shard != now:
                    close()
                    now, part = shard, 0
                if sink is None:
                    temp = f"{root}/temporary/{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}"
                    sink, sha, records, size = where.open_output_stream(temp, compression=None), hashlib.sha256(), 0, 0
                again = (page, same) == last and len(payload) >= revisit_from
                last = (page, same)
                if again and refers is None:
                    refers = page
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = gz.compress(record(page, url, payload, refers, revisit=again or refers is not None)) + gz.flush()
                sink.write(data)
                sha.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, schema.types, strict=True)], schema=schema)

    dealt.mapInArrow(write, _MANIFEST).write.parquet(f"{out}/manifest")
    discard(revisits)
    where, root = fs.FileSystem.from_uri(out)
    with contextlib.suppress(FileNotFoundError):
        where.delete_dir(f"{root}/temporary")
    return read_manifest(df.sparkSession, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")


def parse_records(chunks, verify: bool = True):
    """(headers, HTTP header block, payload) of each record of a gzip stream, given in chunks."""
    data, gz, pending = b"", zlib.decompressobj(31), b""

    def records():
        nonlocal data
        while (end := data.find(b"\r\n\r\n")) >= 0:
            lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record")
            head = dict(x.split(": ", 1) for x in lines[1:])
            n = int(head["Content-Length"])
            if len(data) < end + 8 + n:
                return
            block, data = data[end + 4 : end + 4 + n], data[end + 8 + n :]
            http, _, payload = block.partition(b"\r\n\r\n")
            if verify and (head["WARC-Block-Digest"] != f"sha1:{digest(block)}" or (head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != f"sha1:{digest(payload)}")):
                raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
            yield head, http, payload

    for chunk in chunks:
        pending = chunk
        while pending:
            data += gz.decompress(pending)
            pending = b""
            if gz.eof:
                pending, gz = gz.unused_data, zlib.decompressobj(31)
                yield from records()
    if data:
        raise ValueError("the archive ends inside a record")


def read_archive(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the files in the manifest: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] * payloads
    schema = pa.schema(kinds)
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None

    def read(batches):
        where, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), schema.types, strict=True)], schema=schema)  # noqa: B023, E731
                with where.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, http, payload in parse_records(iter(lambda: f.read(1 << 20), b"")):  # noqa: B023
                        full = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
                        refers = head.get("WARC-Refers-To")
                        row = (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), full, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number(refers) if refers else None)
                        rows.append(row + (payload,) * payloads)
                        held += len(payload) * payloads + 200
                        if held > 4 << 20:
                            yield give()
                            rows, held = [], 0
                yield give()

    files = read_manifest(spark, out).select("file")
    n = max(1, files.count())
    names = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return files.repartition(min(n, 10_000), "file").mapInArrow(read, names)


def archive_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write to a fresh folder in the shared one and read the archive back."""
    out = shared_uri(df.sparkSession, "warc")
    write_archive(df, out, **options)
    return read_archive(df.sparkSession, out)
