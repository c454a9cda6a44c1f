"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus are compiled, with their ids as outputs,
into a minimal acyclic automaton: states with equal continuations are shared,
and each arc carries the number of words that sort before it, so that a walk
yields the word's rank and the rank its ids.  The automaton is one flat file in
the shared folder, memory-mapped by the workers.  A word that it lacks is
merged exactly, by the lowest-ranked pair, leftmost first.

Defined cases: null and empty texts have no ids and decode to the empty text;
the strings of special tokens inside a text are their own ids, as the
tokenizers library does by default; ids decode back to the very bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MEMO_ENTRIES, Memo, join_ids, marks_after_letters, materialize, shared_uri, small_batches, word_pieces

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon at most (some 20 bytes each, so about 1.5 MB).
LEXICON_WORDS = 65_536
#: Words counted in a task before its counts are passed on.
COUNT_FLUSH = 400_000
#: Before a space between such characters a word starts.
_GAP = re.compile(rb"[0-9A-Za-z.,;:!?](?= [0-9A-Za-z])")
#: Longer words are merged, not remembered.
LONGEST_WORD = 48


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def word_starts(piece: np.ndarray) -> np.ndarray:
    """Where the pattern surely parts a text: between a letter and a mark, and
    before a space of which one neighbour is surely not white.  (A space between
    white ones belongs to their run; ``<`` may begin a special token, which ends a
    run as the text's end does.)"""
    sure = (piece > 32) & (piece < 127)
    before, after = np.zeros(len(piece), bool), np.zeros(len(piece), bool)
    before[1:] = sure[:-1]
    before[2:] |= (piece[:-2] == 0xC3) & (piece[1:-1] >= 0x80)
    after[:-1] = (sure[1:] & (piece[1:] != ord("<"))) | (piece[1:] == 0xC3)
    first = np.zeros(len(piece) + 1, bool)
    first[:-1] = (piece == 32) & (before | after)
    first[marks_after_letters(piece)] = True
    return first


def _latin(regex):
    """The pattern for texts below U+0100, with its classes written out, for the faster engine."""
    inside = lambda c: "".join(re.escape(chr(k)) for k in range(256) if regex.fullmatch(c, chr(k)))
    letter, number, space = map(inside, (r"\p{L}", r"\p{N}", r"\s"))
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return re.compile(pattern).findall


class ByteBPE:
    """Vocabulary, merges and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.id_of, self.bytes_of = vocab, {v: k for k, v in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {v: k.encode() for k, v in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault((vocab[a], vocab[b]), (k, vocab[a + b]))
        self.packed = {a << 20 | b: k << 20 | new for (a, b), (k, new) in self.rank.items()}
        slow, fast, latin = regex.compile(PATTERN).findall, _latin(regex), re.compile("[\0-\xff]*").fullmatch
        self.find = lambda text: fast(text) if latin(text) else slow(text)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda s: [s]
        self.tokens = [self.bytes_of.get(k, b"") for k in range(max(self.bytes_of) + 1)]
        self.first = [vocab[bytes([b])] for b in range(256)]

    def merge(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > 64:
            return self._merge_long(parts)
        get, none = self.packed.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k] = new = best & 0xFFFFF
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] << 20 | new, none)
            if k < len(ranks):
                ranks[k] = get(new << 20 | parts[k + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], k, p) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            (_, new), k, (a, b) = heapq.heappop(heap)
            m = after[k]
            if parts[k] != a or m < 0 or parts[m] != b:
                continue
            parts[k], parts[m] = new, -1
            after[k] = after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (p := (parts[x], parts[y])) in rank:
                    heapq.heappush(heap, (rank[p], x, p))
        return [p for p in parts if p >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton and the outputs as one flat block of little-endian words."""
    names = sorted(entries)
    known: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each state: (final, ((byte, state, words below), ...))
    reach: list[int] = []  # words that can be read from a state

    def state(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, *out)
        if key not in known:
            known[key] = len(arcs)
            arcs.append(key)
            reach.append(final + sum(reach[s] for _, s in out))
        return known[key]

    # sorted insertion: a state is closed, and shared, as soon as no later word can pass through it
    path: list[list] = [[False, []]]  # final, closed arcs
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, out = path.pop()
            path[-1][1].append((last[len(path) - 1], state(final, out)))

    for w in names:
        common = next((k for k, (x, y) in enumerate(zip(w, last, strict=False)) if x != y), min(len(w), len(last)))
        close(common)
        path.extend([False, []] for _ in range(len(w) - common))
        path[-1][0], last = True, w
    close(0)
    root = state(*path[0])
    first, label, target, below, final = [0], [], [], [], []
    for key in arcs:
        n = int(key[0])
        for b, s in key[1:]:
            label.append(b)
            target.append(s)
            below.append(n)
            n += reach[s]
        first.append(len(label))
        final.append(int(key[0]))
    ids = [entries[w] for w in names]
    starts = np.cumsum([0, *map(len, ids)])
    parts = [first, target, below, final, starts, [*chain.from_iterable(ids)]]
    head = [root, len(label), *map(len, parts)]
    return np.concatenate([np.asarray(x, "<u4") for x in (head, *parts)]).tobytes() + bytes(label)


class Lexicon:
    """A compiled lexicon over a buffer, such as a memory map."""

    def __init__(self, buffer):
        n = int.from_bytes(buffer[4:8], "little")
        self.buffer, self.labels = buffer, len(buffer) - n
        flat = memoryview(buffer)[: self.labels].cast("I")
        self.root, sizes, at = flat[0], flat[2:8], 8
        parts = []
        for n in sizes:
            parts.append(flat[at : at + n])
            at += n
        self.first, self.target, self.below, self.final, self.starts, self.ids = parts
        self._byte = [bytes([b]) for b in range(256)]

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        s, rank, first, base, find, byte = self.root, 0, self.first, self.labels, self.buffer.find, self._byte
        for b in word:
            at = find(byte[b], base + first[s], base + first[s + 1]) - base
            if at < 0:
                return None
            rank += self.below[at]
            s = self.target[at]
        if not self.final[s]:
            return None
        return bytes(self.ids[self.starts[rank] : self.starts[rank + 1]])


def write_shared(uri: str, data: bytes) -> None:
    """One file under its final name only when it is whole."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(f"{path}.tmp") as f:
        f.write(data)
    where.move(f"{path}.tmp", path)


def open_mapped(uri: str):
    """The file as a memory map; from a remote store, its bytes in an anonymous map."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with where.open_input_file(path) as f:
        data = f.read()
    out = mmap.mmap(-1, len(data))
    out.write(data)
    return out


def frequent_words(df: DataFrame, tokenizer: str, text: str = "text", top: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``top``."""

    def count(batches):
        bpe, seen = ByteBPE(tokenizer), Counter()

        def give():
            found: Counter = Counter()
            for c, n in seen.items():
                for part in bpe.split(c):
                    for w in bpe.find(part) if part not in bpe.special else ():
                        if len(w) <= LONGEST_WORD:
                            found[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([*found.values()], pa.int64())], ["word", "n"])

        for batch in batches:
            for words, _ in word_pieces(batch.column(0), word_starts, _GAP):
                times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                for c, n in zip(words.dictionary.to_pylist(), times.tolist(), strict=True):
                    seen[c] += n
                if len(seen) >= COUNT_FLUSH:
                    yield give()
        yield give()

    counts = small_batches(df).select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(counts, "words")
    # the least count whose words still fit, from a histogram, so that no more than ``top`` words reach the driver
    size = F.floor(F.log2("n") * 16).cast("int")
    room, least = top, None
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r.size
    found = [] if least is None else [r.word for r in counts.where(size >= least).select("word").collect()]
    return sorted(found)


def build_lexicon(df: DataFrame, tokenizer: str, text: str = "text", top: int = LEXICON_WORDS) -> str:
    """Compile the corpus' frequent words; gives the file's URI in the shared folder."""
    bpe = ByteBPE(tokenizer)
    found = [w.encode() for w in frequent_words(df, tokenizer, text, top)]
    uri = f"{shared_uri(df.sparkSession, 'lexicon')}/lexicon.bin"
    write_shared(uri, compile_lexicon({w: bpe.merge(w) for w in found}))
    return uri


class Codec:
    """Encodes to, and decodes from, little-endian 32-bit ids."""

    def __init__(self, tokenizer: str, lexicon: str | None = None):
        self.bpe = ByteBPE(tokenizer)
        self.lexicon = Lexicon(open_mapped(lexicon)) if lexicon else None
        self.special = {k: int(v).to_bytes(4, "little") for k, v in self.bpe.special.items()}
        # nearly all chunks are single words, so words of their own are few
        self.word = Memo(self._word, LONGEST_WORD, MEMO_ENTRIES // 2).__getitem__
        self.chunk = Memo(self._chunk, LONGEST_WORD, 3 * MEMO_ENTRIES // 2).__getitem__

    def _chunk(self, chunk: str) -> bytes:
        parts = self.bpe.split(chunk) if "<" in chunk else [chunk]
        if len(parts) == 1 and len(self.bpe.find(chunk)) == 1:
            return self._word(chunk)
        return b"".join(self.special[p] if p in self.special else b"".join(map(self.word, self.bpe.find(p))) for p in parts)

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        got = self.lexicon.get(raw) if self.lexicon else None
        return np.asarray(self.bpe.merge(raw), "<u4").tobytes() if got is None else got

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; Python sees each chunk once for a piece of the texts."""
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        for words, rows in word_pieces(texts, word_starts, _GAP):
            for k, ids in join_ids(words, [*map(self.chunk, words.dictionary.to_pylist())], rows):
                out[k].append(ids)
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(1)
def shared_codec(tokenizer: str, lexicon: str) -> Codec:
    """One codec for all tasks of a worker process; a lexicon's file never changes."""
    return Codec(tokenizer, lexicon)


def encode_decode(df: DataFrame, tokenizer: str, lexicon: str | None = None, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``key``, ids (little-endian 32-bit) and decoded of every text; with
    ``digests`` instead n_tokens, ids_sha256 and decoded_sha256.  Without a
    ``lexicon`` one is compiled from the texts themselves."""
    from tidemark.llm.token_prefix import _mapped

    lexicon = lexicon or build_lexicon(df, tokenizer, text)
    kinds = [("n_tokens", pa.int64())]
    kinds += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.binary()), ("decoded", pa.string())]

    def make():
        codec = shared_codec(tokenizer, lexicon)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(ids, texts):
            coded = codec.encode_all(texts)
            back = [codec.decode(x) for x in coded]
            pair = [[*map(sha, coded)], [sha(x.encode()) for x in back]] if digests else [coded, back]
            return [ids, [len(x) // 4 for x in coded], *pair]

        return work

    return _mapped(df, key, text, kinds, make, step=4096)
