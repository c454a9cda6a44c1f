"""Hierarchical multi-length packing of token sequences.

Context tiers (4096, 2048, 1024, 512 tokens) are packed from one stream of
documents without any shuffle: a document goes to the smallest tier that holds
it, longer ones are cut into whole windows and a rest.  Each tier keeps one
open window; a rest that does not fit is cut at the window's end, so that every
closed window is full.  At the end of a partition the open windows of shorter
tiers fill the gap of the longest one, and what then remains open is split into
windows of power-of-two length.  There is therefore no padding at all, whatever
the lengths; the tiers only bound how much a short document is mixed with long
ones.  Sequences of one length are numbered on their own and dealt in order to
step groups of :data:`STEP_TOKENS`, so that a step has one length and all steps
have equal token counts; only the last group of each length in a partition may
have fewer.

Memory is bounded by one input batch and one open window for each tier.
Sequence ids carry the partition's number, so a task that runs again gives the
same rows.  Defined cases: null and empty texts are the end id alone; repeated
rows are packed as often as they occur.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, HIGH, KIND, LETTER, MEMO_ENTRIES, PIECE_BYTES, WHITE, join_ids, marks_after_letters, small_batches, word_pieces

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group: as many sequences of a tier as make this up.
STEP_TOKENS = 65_536
#: Local sequence numbers below this; partition numbers above.
_LOCAL_BITS = 36
#: Of these a step group's number within its length; the length's rank above.
_GROUP_BITS = 30
_LATIN = re.compile("[\0-\xff]*").fullmatch


def _starts(piece: np.ndarray) -> np.ndarray:
    """Where words start: after a white byte and, since the vocabulary's pattern
    always parts there, between a Latin letter and a mark."""
    first = np.zeros(len(piece) + 1, bool)
    first[1:] = KIND[piece] == WHITE
    first[marks_after_letters(piece)] = True
    return first


def _lowered(piece: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """ASCII letters lowered, but for words whose letters normalisation may join
    with others (above U+00FF) and what might be a special token."""
    kind = KIND[piece]
    low = np.where(kind == LETTER, piece | np.uint8(32), piece)
    apart = kind == HIGH
    apart[:-1] |= (piece[:-1] == ord("<")) & (piece[1:] == ord("|"))
    if apart.any():
        keep = np.repeat(np.logical_or.reduceat(apart, bounds[:-1]), np.diff(bounds))
        low[keep] = piece[keep]
    return low


class WordEncoder:
    """Ids of a tokenizers file that drops white space and marks the ends of words.

    Texts are cut into words by array operations, and the words of a piece are
    dictionary-encoded, so that Python sees each of them once for a piece.  Their
    ids are remembered.  New words of Latin letters alone go to the library
    together as one text, whose ids part after each end of a word; other new
    words, which may be several to the library, go as they are.
    """

    def __init__(self, path: str, end: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[v for k, v in spec["model"]["vocab"].items() if k.endswith(suffix)]] = True
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.end = b"" if end is None else int(end).to_bytes(4, "little")
        self.known, self.old = {}, {}

    def _library(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Makes sure that all of ``words``, which are distinct, are remembered."""
        known, old = self.known, self.old
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MEMO_ENTRIES:  # the young memo becomes the old one
            self.old, self.known = old, known = known, {}
            new = words
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in known]
        plain = [w for w in new if w.isalpha() and _LATIN(w)]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            (flat,) = self._library([" ".join(part)])
            cut = (4 * (np.flatnonzero(self.ends[np.frombuffer(flat, "<u4")]) + 1)).tolist()
            if len(cut) == len(part):
                known.update(zip(part, (flat[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)), strict=True))
        other = [w for w in new if w not in known]
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            known.update(zip(part, self._library(part), strict=True))

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        for words, rows in word_pieces(texts, _starts, GAP, PIECE_BYTES, _lowered):
            names = pc.ascii_rtrim_whitespace(words.dictionary).to_pylist()
            self._learn([*dict.fromkeys(names)])
            for k, ids in join_ids(words, [*map(self.known.__getitem__, names)], rows):
                out[k].append(ids)
        return [b"".join(x) + self.end for x in out]


@functools.lru_cache(1)
def word_encoder(path: str, end: int | None = None) -> WordEncoder:
    """One encoder for all tasks of a worker process: what it remembers depends on
    the vocabulary alone."""
    return WordEncoder(path, end)


class Packer:
    """Packs one partition's documents; rows are (key, start, length, ids, doc_tokens, sequence, offset, tier)."""

    def __init__(self, first: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.next = tiers, first
        self.open: dict[int, list[list]] = {t: [] for t in tiers}  # pieces [key, start, ids, doc_tokens]
        self.used = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []
        self.groups: list[int] = []  # the step group of each row
        lengths = sorted({*tiers, *(1 << k for k in range(tiers[-1].bit_length()))})
        self.ranks = {t: first | k << _GROUP_BITS for k, t in enumerate(lengths)}
        self.closed = dict.fromkeys(lengths, 0)

    def _close(self, pieces: list[list], tier: int) -> None:
        offset, group = 0, self.ranks[tier] | self.closed[tier] // max(STEP_TOKENS // tier, 1)
        self.groups += [group] * len(pieces)
        self.closed[tier] += 1
        for key, start, ids, n in pieces:
            self.rows.append((key, start, len(ids) // 4, ids, n, self.next, offset, tier))
            offset += len(ids) // 4
        self.next += 1

    def _put(self, tier: int, key, start: int, ids: bytes, n: int) -> None:
        while ids:
            room = 4 * (tier - self.used[tier])
            part, ids = ids[:room], ids[room:]
            self.open[tier].append([key, start, part, n])
            self.used[tier] += len(part) // 4
            start += len(part) // 4
            if self.used[tier] == tier:
                self._close(self.open[tier], tier)
                self.open[tier], self.used[tier] = [], 0

    def add(self, key, ids: bytes) -> None:
        n, top, start = len(ids) // 4, self.tiers[-1], 0
        while n - start >= top:  # whole windows
            self._close([[key, start, ids[4 * start : 4 * (start + top)], n]], top)
            start += top
        if n > start:
            tier = next(t for t in self.tiers if n - start <= t)
            self._put(tier, key, start, ids[4 * start :], n)

    def finish(self) -> None:
        top = self.tiers[-1]
        for tier in reversed(self.tiers[:-1]):  # gaps of long windows take what shorter tiers have left
            pieces, self.open[tier], self.used[tier] = self.open[tier], [], 0
            for key, start, ids, n in pieces:
                self._put(top, key, start, ids, n)
        rest, left = self.open[top], self.used[top]
        self.open[top], self.used[top] = [], 0
        while left:  # windows of power-of-two length need no padding
            size = 1 << (left.bit_length() - 1)
            room, pieces = 4 * size, []
            while room:
                key, start, ids, n = rest[0]
                part = ids[:room]
                pieces.append([key, start, part, n])
                room -= len(part)
                if len(part) == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = [key, start + len(part) // 4, ids[len(part) :], n]
            self._close(pieces, size)
            left -= size


def pack(df: DataFrame, make_encoder: Callable[[], Callable[[list], list[bytes]]], key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, digests: bool = False) -> DataFrame:
    """One row for each piece: ``key``, start, length, ids (with ``digests``
    ids_crc32), doc_tokens, sequence_id, offset, sequence_length, step_group."""
    last = ("ids_crc32", "bigint", pa.int64()) if digests else ("ids", "binary", pa.binary())
    fields = [("start", "bigint", pa.int64()), ("length", "bigint", pa.int64()), last, ("doc_tokens", "bigint", pa.int64()), ("sequence_id", "bigint", pa.int64()), ("offset", "bigint", pa.int64()), ("sequence_length", "bigint", pa.int64()), ("step_group", "bigint", pa.int64())]
    schema = pa.schema([(key, pa.int64()), *((n, t) for n, _, t in fields)])

    def run(batches):
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << _LOCAL_BITS
        encoder, packer = make_encoder(), Packer(first, tiers)

        def give():
            rows, group, packer.rows, packer.groups = packer.rows, packer.groups, [], []
            cols = [*zip(*rows, strict=True)] or [[]] * 8
            ids = [zlib.crc32(x) for x in cols[3]] if digests else cols[3]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*cols[:3], ids, *cols[4:], group], schema.types, strict=True)], schema=schema)

        for batch in batches:
            for at, (k, ids) in enumerate(zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist()), strict=True), 1):
                packer.add(k, ids)
                if at % 256 == 0:
                    yield give()
            yield give()
        packer.finish()
        yield give()

    return small_batches(df).select(F.col(key).cast("bigint").alias(key), F.col(text)).mapInArrow(run, f"{key} bigint, " + ", ".join(f"{n} {s}" for n, s, _ in fields))
