"""Token counts: exact token count of every prefix of a text, by dynamic programming.

The vocabulary is a BPE model with byte fallback.  A text's units are runs of
the space mark followed by other characters; no piece reaches over the start
of a unit, so counts of units add up.  Inside a unit, the last token of a
prefix's encoding is the one piece ``t`` that ends there and whose pair
``(last token before t, t)`` is itself encoded as two tokens; hence
``count[i] = count[i - len(t)] + 1`` gives the exact count at every prefix
in one sweep, and truncation or budget questions are array look-ups.

Defined cases: null and empty texts count 0 tokens; characters outside the
vocabulary count one token for each UTF-8 byte; other columns stay untouched.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MEMO_ENTRIES, Memo, over_rows, small_batches

MARK = "▁"
#: A unit: space marks, other characters that are no letters, letters.  No piece goes on after a letter with anything but a letter.
_UNIT = re.compile(rf"{MARK}*(?:(?![{MARK}\n])[\W\d_¹²³])*[^\W\d_¹²³]+|{MARK}*(?:(?![{MARK}\n])[\W\d_¹²³])+|{MARK}+|\n")
_OVER = re.compile(rf".{MARK}(?<!{MARK}{MARK})|[^\W\d_¹²³][\W\d_¹²³]|\n.|.\n", re.DOTALL)
#: Units up to so many characters are remembered.
MEMO_UNIT = 40


class PrefixCounter:
    """Exact counts of sentencepiece's encoding, for every prefix of a text."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if any(map(_OVER.search, self.score)):
            raise ValueError(f"a piece reaches over the end of a unit: {[p for p in self.score if _OVER.search(p)][:9]}")
        self.pieces = [p for p in self.score if self.merge(p) == [p]]
        self.ends = ahocorasick.Automaton()
        for k, p in enumerate(self.pieces):
            self.ends.add_word(p, (len(p), k))
        self.ends.make_automaton()
        self._pairs: dict[int, bool] = {}
        self.unit = Memo(self._unit, MEMO_UNIT).__getitem__
        self.chunk = Memo(self._chunk, MEMO_UNIT).__getitem__

    def merge(self, text: str) -> list[str]:
        """The encoding by the definition: join the neighbours of best score, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: int, b: int) -> bool:
        if len(self._pairs) > MEMO_ENTRIES:
            self._pairs.clear()
        x, y = self.pieces[a], self.pieces[b]
        got = self._pairs[a << 20 | b] = self.merge(x + y) == [x, y]
        return got

    def _unit(self, unit: str) -> np.ndarray | bytes:
        """Counts at the unit's prefixes of 1, 2, ... characters."""
        last, count, pairs = [-1], [0], self._pairs
        for end, (n, t) in self.ends.iter(unit):
            if end < len(last) - 1:
                continue  # the last piece of this prefix is found
            while end > len(last) - 1:  # characters that the vocabulary lacks: their bytes; nothing merges with them
                count.append(count[-1] + len(unit[len(last) - 1].encode("utf-8", "surrogatepass")))
                last.append(-1)
            before = last[end + 1 - n]
            if before >= 0 and n <= end:
                fits = pairs.get(before << 20 | t)
                if not (self._pair(before, t) if fits is None else fits):
                    continue
            last.append(t)
            count.append(count[end + 1 - n] + 1)
        while len(last) <= len(unit):
            count.append(count[-1] + len(unit[len(last) - 1].encode("utf-8", "surrogatepass")))
            last.append(-1)
        if len(unit) > MEMO_UNIT or count[-1] > 255:
            return np.array(count[1:], np.int64)
        return bytes(count[1:])

    def _chunk(self, chunk: str) -> np.ndarray | bytes:
        """Counts at the prefixes of a word with the mark before it."""
        parts = [self.unit(u) for u in _UNIT.findall(MARK + chunk)]
        if len(chunk) > MEMO_UNIT or sum(x[-1] for x in parts) > 255:
            parts = [np.frombuffer(x, np.uint8).astype(np.int64) if type(x) is bytes else x for x in parts]
            return np.concatenate([x + sum(int(y[-1]) for y in parts[:k]) for k, x in enumerate(parts)])
        got = parts[0]
        for x in parts[1:]:
            base = got[-1]
            got += bytes([base + v for v in x])
        return got

    def prefixes(self, text: str | None) -> np.ndarray:
        """``counts[i]``: tokens of ``text[:i]``, for i from 0 to ``len(text)``."""
        if not text:
            return np.zeros(1, np.int64)
        if " " in (text[0], text[-1]) or "  " in text or MARK in text:
            units = _UNIT.findall(MARK + text.replace(" ", MARK))
            found = [*map(self.unit, units)]
        else:
            found = [*map(self.chunk, text.split(" "))]
        if all(type(x) is bytes for x in found):
            flat = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        else:
            flat = np.concatenate([np.frombuffer(x, np.uint8).astype(np.int64) if type(x) is bytes else x for x in found])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths)
        totals = flat[ends - 1]
        flat += np.repeat(np.cumsum(totals) - totals, lengths)
        flat[0] = 0  # the mark before the text alone is the empty prefix
        return flat

    def truncate(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


@functools.lru_cache(1)
def shared_counter(model_file: str) -> PrefixCounter:
    """One counter for all tasks of a worker process: what it remembers depends on
    the model alone."""
    return PrefixCounter(model_file)


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit and ``fits_chars`` (the characters
    of the longest prefix of at most ``limit`` tokens); with ``keep_prefixes``
    also ``prefix_tokens``, the little-endian 32-bit counts of all prefixes."""
    kinds = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fits_chars", pa.int64())]
    kinds += [("prefix_tokens", pa.binary())] * keep_prefixes

    def make():
        counter = shared_counter(model_file)

        def work(ids, texts):
            out: list[list] = [ids, *([] for _ in kinds)]
            for x in texts:
                counts = counter.prefixes(x)
                n = int(counts[-1])
                fits = len(counts) - 1 if n <= limit else int(np.flatnonzero(counts <= limit)[-1])
                for c, v in zip(out[1:], (len((x or "").encode("utf-8", "surrogatepass")), n, n > limit, fits, counts), strict=False):
                    c.append(v.astype("<u4").tobytes() if v is counts else v)
            return out

        return work

    return _mapped(df, key, text, kinds, make)


def _mapped(df: DataFrame, key: str, text: str, kinds: list, make, step: int = 256) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
    from pyspark.sql.types import StructField, StructType

    kind = df.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), *kinds])
    out = StructType([StructField(key, kind), *from_arrow_schema(schema).fields[1:]])
    return small_batches(df).select(F.col(key), F.col(text)).mapInArrow(over_rows([key, text], schema, make, step), out)
