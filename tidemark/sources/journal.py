"""Spark data source ``framed``: journals of length-prefixed messages.

Reading: one row for each frame (path, frame_no, offset, payload_len, checksum,
payload, error).  Large files are split at true frame boundaries, which the sink
writes down beside each journal; :func:`build_index` does so for others, as a
Spark job.  Without such an index the driver looks at :data:`PLAN_BLOCKS` blocks
of headers at most, and what follows is one range.  Options: ``checksum`` (none, crc16, crc32, xxh3 or a
registered name), ``format`` (a registered FrameFormat), ``maxFrameLen``,
``mode`` (failfast or permissive), ``verify``, ``headerOnly`` (payloads are
skipped, not read), ``splitBytes``.

Writing: each task writes one journal of the ``payload`` column, in the order
of its rows, under a temporary name; the commit renames all and only then
deletes what an overwrite replaces.  Options:
``checksum``, ``format``, ``maxPayloadLen``.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tidemark.errors import ERROR_FIELDS, ERROR_TYPE, ChecksumMismatch, JournalError
from tidemark.functions.batches import parts, small_batches
from tidemark.sources.codec import DEFAULT_MAX_FRAME, FrameFormat, Frames, binary_buffers, format_of, headers, scan
from tidemark.sources.files import listing, locate, open_input, publish, read_at

SCHEMA = f"path string, frame_no bigint, offset bigint, payload_len bigint, checksum decimal(20,0), payload binary, error {ERROR_TYPE}"
SPLIT_BYTES = 64 << 20
#: Bytes between two boundaries of an index; blocks of headers that the driver reads of a file without one.
INDEX_BYTES, PLAN_BLOCKS = 8 << 20, 1024

_ERROR_ARROW = pa.struct([(f, pa.int64() if f in ("declared_len", "buffer_len", "limit") else pa.string()) for f in ERROR_FIELDS])
ARROW = pa.schema([("path", pa.string()), ("frame_no", pa.int64()), ("offset", pa.int64()), ("payload_len", pa.int64()), ("checksum", pa.decimal128(20, 0)), ("payload", pa.binary()), ("error", _ERROR_ARROW)])


def _format(options: dict) -> FrameFormat:
    return format_of(options.get("checksum", "none"), int(options.get("maxframelen", options.get("maxFrameLen", DEFAULT_MAX_FRAME))), options.get("format"))


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, options.get(name.lower(), default))).lower() == "true"


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int | None
    first: int


def pieces(path: str, size: int, form: FrameFormat, split: int = SPLIT_BYTES) -> list[Piece]:
    """Ranges of whole frames of about ``split`` bytes; what cannot be walked over is left to the last one."""
    if size <= split:
        return [Piece(path, 0, None, 0)]
    marks = read_index(path, size, form)
    if marks is None:
        marks = [*boundaries(path, size, form, split, PLAN_BLOCKS)]
    out, start, first = [], 0, 0
    for at, number in marks:
        if at - start >= split:
            out.append(Piece(path, start, at, first))
            start, first = at, number
    out.append(Piece(path, start, None, first))
    return out


def boundaries(path: str, size: int, form: FrameFormat, every: int = INDEX_BYTES, blocks: int | None = None) -> Iterator[tuple[int, int]]:
    """(offset, number) of the frames that are the first ``every`` bytes or more after
    the one before, in the first ``blocks`` blocks of headers; ends where the journal fails."""
    last, number = 0, 0
    with contextlib.suppress(JournalError):
        for offsets, _, _ in itertools.islice(headers(read_at(path), size, form), blocks):
            while (k := int(np.searchsorted(offsets, last + every))) < len(offsets):
                last = int(offsets[k])
                yield last, number + k
            number += len(offsets)


def index_name(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/_{name}.index"


def read_index(path: str, size: int, form: FrameFormat) -> list[tuple[int, int]] | None:
    """The boundaries written beside a journal, if they are of its present size and header."""
    with contextlib.suppress(FileNotFoundError, ValueError), open_input(index_name(path)) as f:
        got = json.loads(f.read())
        if got["size"] == size and got["header"] == form.header_size:
            return [*map(tuple, got["marks"])]
    return None


def build_index(spark: SparkSession, path: str, **options) -> int:
    """Write the index of each journal at ``path`` that lacks one, a task for a file; gives their number."""
    form = _format(options)
    files = [(p, n) for p, n in listing(path) if n > SPLIT_BYTES and read_index(p, n, form) is None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                publish(index_name(name), _index(size, form, [*boundaries(name, size, form)]))
            yield batch.select([1])

    if not files:
        return 0
    return spark.createDataFrame(files, "path string, size bigint").repartition(len(files)).mapInArrow(run, "size bigint").count()


def _index(size: int, form: FrameFormat, marks: list) -> bytes:
    return json.dumps({"size": size, "header": form.header_size, "marks": marks}).encode()


def batch_of(path: str, got: Frames, form: FrameFormat, header_only: bool = False) -> pa.RecordBatch:
    n = len(got.offsets)
    sums = pa.array(got.sums.tolist(), pa.decimal128(20, 0)) if form.checksum.width else pa.nulls(n, pa.decimal128(20, 0))
    errors = pa.nulls(n, _ERROR_ARROW)
    if got.wrong is not None and len(got.wrong):
        found = [None] * n
        for k, own in zip(got.wrong.tolist(), got.own.tolist(), strict=True):
            found[k] = ChecksumMismatch("checksum differs", expected=int(got.sums[k]), calculated=own).row()
        errors = pa.array(found, _ERROR_ARROW)
    payloads = pa.nulls(n, pa.binary()) if header_only else got.payloads
    columns = [pa.repeat(pa.scalar(path), n), pa.array(got.first + np.arange(n)), pa.array(got.offsets), pa.array(got.lengths), sums, payloads, errors]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def error_row(path: str, number: int, got: Frames, form: FrameFormat) -> pa.RecordBatch:
    at, length, expected, payload = got.bad or (None, None, None, None)
    row = {"path": path, "frame_no": number, "offset": at, "payload_len": length, "checksum": expected, "payload": payload, "error": got.failure.row()}
    return pa.RecordBatch.from_pylist([row], schema=ARROW)


def read_piece(piece: Piece, form: FrameFormat, options: dict) -> Iterator[pa.RecordBatch]:
    permissive = str(options.get("mode", "failfast")).lower() == "permissive"
    if _flag(options, "headerOnly", False):
        yield from _headers(piece, form, permissive)
        return
    with open_input(piece.path) as f:
        for got in scan(f, form, piece.start, piece.end, piece.first, _flag(options, "verify", True), permissive, together=True):
            for at in range(0, len(got.offsets), 65_536):
                yield batch_of(piece.path, got.part(at, at + 65_536), form)
            if got.failure:
                if not permissive:
                    raise got.failure
                yield error_row(piece.path, got.first + len(got.offsets), got, form)


def _headers(piece: Piece, form: FrameFormat, permissive: bool) -> Iterator[pa.RecordBatch]:
    size, first, held, n = open_input(piece.path).size(), piece.first, [], 0

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal first, held, n
        if held:
            yield batch_of(piece.path, Frames(first, *map(np.concatenate, zip(*held, strict=True)), None), form, True)
        first, held, n = first + n, [], 0

    try:
        for got in headers(read_at(piece.path), size, form, piece.start, piece.end):
            held.append(got)
            n += len(got[0])
            if n >= 65_536:
                yield from give()
    except JournalError as failure:
        yield from give()
        if not permissive:
            raise
        yield error_row(piece.path, first, Frames(0, np.zeros(0), np.zeros(0), np.zeros(0), None, failure), form)
    yield from give()


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.form = _format(self.options)

    def partitions(self) -> list[Piece]:
        split = int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES)))
        return [p for path, size in listing(self.options["path"]) for p in pieces(path, size, self.form, split)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from read_piece(partition, self.form, self.options)


class JournalStreamReader(DataSourceStreamReader):
    """New files of a folder, each once and whole, whatever their names; the offset
    has all names taken that are still there (``last``: of older checkpoints, all up to it)."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.form = _format(self.options)

    def initialOffset(self) -> dict:
        return {"names": []}

    def latestOffset(self) -> dict:
        return {"names": [path for path, _ in listing(self.options["path"])]}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, upto = ((set(x.get("names", ())), x.get("last", "")) for x in (start, end))
        taken = lambda path, offset: path in offset[0] or path <= offset[1]
        return [p for path, size in listing(self.options["path"]) if taken(path, upto) and not taken(path, before) for p in pieces(path, size, self.form)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from read_piece(partition, self.form, self.options)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    temp: str
    final: str
    frames: int
    bytes: int
    marks: list


class JournalWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, column: int):
        self.options, self.overwrite, self.column = dict(options), overwrite, column
        self.form = _format(self.options)
        bound = self.options.get("maxpayloadlen", self.options.get("maxPayloadLen"))
        self.bound = None if bound is None else int(bound)
        self.run = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, root = locate(self.options["path"])
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        part = f"journal-{self.run}-{task.partitionId():05d}"
        temp, n, size, marks = f"{root}/_{part}.{task.taskAttemptId()}", 0, 0, []
        with where.open_output_stream(temp, compression=None) as f:
            for batch in iterator:
                payloads = batch.column(self.column)
                for s in parts(np.diff(binary_buffers(payloads)[0])):
                    data = self.form.encode(payloads[s], self.bound)
                    if size - (marks[-1][0] if marks else 0) >= INDEX_BYTES:
                        marks.append((size, n))
                    f.write(data)
                    n, size = n + s.stop - s.start, size + len(data)
        return Written(temp, f"{root}/{part}.journal", n, size, marks)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = locate(self.options["path"])
        old = [locate(p)[1] for p, _ in listing(self.options["path"])] if self.overwrite and where.get_file_info(root).type == fs.FileType.Directory else []
        for m in messages:
            if m and m.frames:
                if m.marks:
                    publish(f"{self.options['path'].rstrip('/')}/{index_name(m.final).rpartition('/')[2]}", _index(m.bytes, self.form, m.marks))
                where.move(m.temp, m.final)
            elif m:
                where.delete_file(m.temp)
        for name in old:  # what is replaced goes last: a job that fails leaves it
            for x in (name, index_name(name)):
                with contextlib.suppress(FileNotFoundError):
                    where.delete_file(x)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = locate(self.options["path"])
        for m in messages:
            if m:
                with contextlib.suppress(FileNotFoundError):
                    where.delete_file(m.temp)


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options)

    def streamReader(self, schema) -> JournalStreamReader:
        return JournalStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> JournalWriter:
        return JournalWriter(self.options, overwrite, schema.names.index("payload"))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FramedSource)
    return small_batches(spark)

