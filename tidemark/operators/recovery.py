"""Crash recovery: how far each journal is sound, and an explicit repair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import ERROR_FIELDS, ERROR_TYPE, JournalError, UnexpectedEof
from tidemark.sources.codec import FrameFormat, format_of, scan
from tidemark.sources.files import listing, locate, open_input

REPORT = f"path string, frames bigint, last_good_offset bigint, end string, error {ERROR_TYPE}"


def recover_stream(source, form: FrameFormat, start: int = 0) -> tuple[int, int, str]:
    """(frames, offset after the last good one relative to ``start``, CleanEof or
    TornTail); whatever is not a torn end is raised, and gives no offset."""
    frames, good = 0, 0
    for got in scan(source, form, start):
        frames += len(got.offsets)
        if len(got.offsets):
            good = int(got.offsets[-1] + form.header_size + got.lengths[-1]) - start
        if isinstance(got.failure, UnexpectedEof):
            return frames, good, "TornTail"
        if got.failure:
            raise got.failure
    return frames, good, "CleanEof"


def recover(spark: SparkSession, path: str, checksum: str = "none", **options) -> DataFrame:
    """One row for each journal at ``path``: ``end`` or ``error``, never both."""
    form = format_of(checksum, **options)
    files = [p for p, _ in listing(path)]
    error = pa.struct([(f, pa.int64() if f in ("declared_len", "buffer_len", "limit") else pa.string()) for f in ERROR_FIELDS])
    schema = pa.schema([("path", pa.string()), ("frames", pa.int64()), ("last_good_offset", pa.int64()), ("end", pa.string()), ("error", error)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                row = dict.fromkeys(schema.names) | {"path": name}
                try:
                    with open_input(name) as f:
                        row["frames"], row["last_good_offset"], row["end"] = recover_stream(f, form)
                except JournalError as e:
                    row["error"] = e.row()
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    names = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    return names.mapInArrow(run, REPORT)


def repair(path: str, checksum: str = "none", **options) -> dict:
    """Cut one journal's torn tail off (a new file takes its place); raises where the damage is no torn tail."""
    form = format_of(checksum, **options)
    where, name = locate(path)
    with open_input(path) as f:
        frames, good, end = recover_stream(f, form)
        if end == "TornTail":
            with where.open_output_stream(f"{name}.repaired", compression=None) as out:
                at = 0
                while at < good:
                    part = f.read_at(min(8 << 20, good - at), at)
                    out.write(part)
                    at += len(part)
    if end == "TornTail":
        where.move(f"{name}.repaired", name)
    return {"path": path, "frames": frames, "last_good_offset": good, "end": end}


def append(path: str, payloads: pa.Array, checksum: str = "none", **options) -> int:
    """Append frames to a sound journal; gives the offset where they begin."""
    form = format_of(checksum, **options)
    where, name = locate(path)
    size = where.get_file_info(name).size
    with where.open_append_stream(name) as out:
        out.write(form.encode(payloads))
    return size
