"""Shared plumbing of the training-data operators: shared folder, tables, words.

Everything that has to outlive a task goes through :func:`shared_uri`, i.e. the
folder named by ``spark.checkpoint.dir``; nothing is kept on a machine's own
disk.  Lineage is cut with written Parquet tables (:func:`materialize`), which
survive the loss of an executor.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED = "file:///tmp/checkpoints/tidemark"
#: Bytes of the batches that go to Python workers; one row may have more.
BATCH_BYTES = 4 << 20
#: Entries a worker's memo of words may hold before it starts again from empty.
MEMO_ENTRIES = 500_000
#: Of longer texts so many bytes are looked at together.
PIECE_BYTES = 1 << 22
_WHITE = " \t\n\x0b\x0c\r"
GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Kinds of bytes: white, ASCII letters, punctuation that begins no contraction or
#: special token, second bytes of the letters from U+00C0 to U+00FF, first bytes above U+00FF.
WHITE, LETTER, MARK, TAIL, HIGH = range(1, 6)
KIND = np.zeros(256, np.uint8)
KIND[[*b" \t\n\v\f\r"]] = WHITE
KIND[[c for c in range(128) if chr(c).isalpha()]] = LETTER
KIND[[*b'.,;:!?)"']] = MARK
KIND[[c for c in range(0x80, 0xC0) if chr(c + 0x40).isalpha()]] = TAIL
KIND[0xC4:] = HIGH


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only a session on one machine has a default."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or DEFAULT_SHARED).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session has been told to hand rows to Python workers in
    batches of at most :data:`BATCH_BYTES` (unless it has been told otherwise),
    so that long texts don't add up in a task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark, uri = df.sparkSession, shared_uri(df.sparkSession, name)
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._tidemark_uri = uri
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for df in tables:
        uri = getattr(df, "_tidemark_uri", None)
        if not uri:
            continue
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def over_rows(columns: list[str], schema: pa.Schema, make: Callable[[], Callable[[list], list]], step: int = 256):
    """A ``mapInArrow`` function: ``make()`` runs once in each task and gives a
    function from ``step`` rows (one list for each of ``columns``) to the lists
    of the output's columns; output batches stay as small as the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = work(*[part.column(c).to_pylist() for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, schema.types, strict=True)], schema=schema)

    return run


def marks_after_letters(piece: np.ndarray) -> np.ndarray:
    """Where a mark follows a letter below U+0100."""
    kind = KIND[piece]
    mark = np.flatnonzero(kind == MARK)
    mark = mark[mark > 1]
    return mark[(kind[mark - 1] == LETTER) | (piece[mark - 2] == 0xC3) & (kind[mark - 1] == TAIL)]


def word_pieces(texts: list | pa.Array, starts: Callable, gap: re.Pattern, size: int = PIECE_BYTES, change: Callable | None = None) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """The texts' words, dictionary-encoded, and the text's number of each word,
    in pieces of some ``size`` bytes; a text without bytes has no word.

    ``starts`` gives from a piece's bytes where words start (one flag more than
    bytes), ``change`` from bytes and bounds what is encoded instead.  Texts part
    words too.  Pieces end with a text or with a match of ``gap``, after which a
    word must start, so a text of any length is looked at in turns."""
    array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    array = array if array.type == pa.string() else array.cast(pa.string())
    array = array.fill_null("") if array.null_count else array
    if not len(array):
        return
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    lo, end = int(at[0]), int(at[-1])
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if lo < end else None
    while lo < end:
        hi = min(lo + size, end)
        if hi < end:
            stop = int(at[np.searchsorted(at, hi)])
            found = gap.search(memoryview(data), hi, stop)
            hi = found.end() if found else stop
        piece = flat[lo:hi]
        first = starts(piece)
        first[0] = first[at[(at >= lo) & (at < hi)] - lo] = first[-1] = True
        bounds = np.flatnonzero(first)
        rows = np.searchsorted(at, bounds[:-1] + lo, "right") - 1
        piece = change(piece, bounds) if change else piece
        words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(piece))
        yield words.dictionary_encode(), rows
        lo = hi


def join_ids(words: pa.DictionaryArray, found: list[bytes], rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(text's number, ids of its words) of a piece; ``found`` are the little-endian
    32-bit ids of the dictionary's words."""
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat, index = np.frombuffer(b"".join(found), "<u4"), words.indices.to_numpy()
    n = size[index]
    ends = np.cumsum(n)
    ids = flat[np.repeat((np.cumsum(size) - size)[index] - (ends - n), n) + np.arange(ends[-1])]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    cuts = [*(ends - n)[first].tolist(), len(ids)]
    for k, i, j in zip(rows[first].tolist(), cuts, cuts[1:], strict=False):
        yield k, ids[i:j].tobytes()


def white_chars(text: str) -> int:
    return sum(text.count(c) for c in _WHITE)


class Memo(dict):
    """key -> ``make(key)``, remembered in two generations: when the young one is
    full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, make: Callable, longest: int, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.longest, self.entries, self.old = make, longest, entries // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), bijective."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of all words of a text at once, by array operations.

    A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  Up to 16 bytes
    are two whole numbers, which are mixed with the length; a longer word goes
    through XXH3.  No sum over bytes is taken, so that no pair of words, however
    regular, collides by construction."""

    def __init__(self, fold_case: bool = False):
        self.fold = fold_case
        self.white = bytes(c in (9, 10, 11, 12, 13, 32) for c in range(256))
        #: The first k of eight bytes.
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) <= PIECE_BYTES:
            return self._piece(raw)
        cuts = [0]
        while m := GAP.search(raw, cuts[-1] + PIECE_BYTES):
            cuts.append(m.end())
        return np.concatenate([self._piece(raw[i:j]) for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)])

    def _piece(self, raw: bytes) -> np.ndarray:
        if not raw:
            return np.zeros(0, np.uint64)
        size = len(raw)
        raw = (raw.lower() if self.fold else raw) + bytes(16)
        gap = np.frombuffer(b"\1" + raw[:size].translate(self.white) + b"\1", bool)
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        n = ends - starts
        eight = np.ndarray(size + 9, "<u8", raw, strides=(1,))
        first = eight[starts]
        first &= self.mask[np.minimum(n, 8)]
        first += n.view(np.uint64) * np.uint64(0x9E3779B185EBCA87)
        out = mix(first)
        more = np.flatnonzero(n > 8)
        if len(more):
            rest = n[more] - 8
            then = eight[starts[more] + 8] & self.mask[np.minimum(rest, 8)]
            out[more] = mix(out[more] + then * np.uint64(0xC2B2AE3D27D4EB4F))
            for k in more[rest > 8].tolist():
                out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
        return out


_STEPS = np.random.default_rng(20_240_301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` (at most 63) word hashes; of the whole, if shorter."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, int(_STEPS[63]) * width % (1 << 64), np.uint64)
    for k in range(width):
        out += h[k : n + k] * _STEPS[k]
    return mix(out)
