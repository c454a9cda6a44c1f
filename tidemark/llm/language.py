"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (n = 1
to 3, words bounded by a blank).  A document's own ranking is compared with
each profile by the out-of-place distance: the sum, over the document's
n-grams, of how far the ranks are apart, at most the profile's length for one
that it lacks.  The nearest profile is the prediction.

Profiles are fitted on at most :data:`FIT_DOCS` documents of each language,
picked by a hash of their id; every document's whole text is classified.
Defined cases: null texts and texts without a letter are ``und`` with score 0;
with nothing to learn from, all are; ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: N-grams in a profile, and of a document that are compared.
PROFILE = 400
#: Documents of each language to fit on, about (the bound of the fit's sample).
FIT_DOCS = 2_000
#: Characters that are counted together.
PIECE_CHARS = 1 << 18

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _counted(found: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs (or the sum of its counts)."""
    if counts is None:
        found.sort()
    else:
        order = np.argsort(found, kind="stable")
        found, counts = found[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, len(found))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers (21 bits a character) and their counts; long
    texts are counted piece by piece."""
    low, held, last = (text or "").lower(), [], np.zeros(1, np.int64)
    for at in range(0, len(low), PIECE_CHARS):
        c = np.frombuffer(low[at : at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letter_table()[c], c, 0).astype(np.int64)
        c = np.concatenate([last, c, [0] if at + PIECE_CHARS >= len(low) else []]).astype(np.int64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        new = len(last)  # n-grams that end in an earlier piece have been counted
        one, two = c[new:], c[new - 1 : -1] << 21 | c[new:]
        middle = max(new - 1, 1)
        three = (c[middle - 1 : -2] << 42 | c[middle:-1] << 21 | c[middle + 1 :])[c[middle:-1] != 0]
        held.append(_counted(np.concatenate([one[one != 0], two, three])))
        last = c[-2:]
    if len(held) < 2:
        return held[0] if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return _counted(*map(np.concatenate, zip(*held, strict=True)))


def ranking(found: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The ``top`` n-grams by count; ties by the n-gram's number."""
    if len(found) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = np.flatnonzero(counts >= least)
        found, counts = found[some], counts[some]
    return found[np.argsort(-counts, kind="stable")][:top]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]):
        self.langs = sorted(ranked)
        self.known = np.unique(np.concatenate([np.zeros(1, np.int64), *(np.asarray(ranked[x], np.int64) for x in self.langs)]))
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for k, x in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.known, np.asarray(ranked[x], np.int64))] = np.arange(len(ranked[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranking(*grams(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.known, own)
        at[self.known[np.minimum(at, len(self.known) - 1)] != own] = len(self.known)
        rank = self.rank[:, at]
        off = np.where(rank < 0, PROFILE, np.minimum(np.abs(rank - np.arange(len(own))), PROFILE)).sum(1)
        best = int(np.argmin(off))
        return self.langs[best], float(1 - off[best] / (PROFILE * len(own)))


def fit(df: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> Profiles:
    """Profiles from rows with a label; the sample's share follows from the labels' counts."""
    df = small_batches(df).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, fit_docs / n))])
    picked = df.where(F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(1_000_003)) < share[F.col(label)] * 1_000_003)

    def count(batches):
        for batch in batches:
            held: dict[str, list] = {}
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(x)
            for lang, texts in held.items():
                found, counts = grams("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts)], ["lang", "gram", "n"])

    sums = picked.select(F.col(label), F.col(text)).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list] = {}
    for r in sums.withColumn("k", rank).where(F.col("k") <= PROFILE).orderBy("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return Profiles(out)


def identify(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score (1 less the mean distance as a share of the largest)."""
    from tidemark.llm.token_prefix import _mapped

    def make():
        return lambda ids, texts: [ids, *zip(*map(profiles.predict, texts), strict=True)]

    return _mapped(df, key, text, [("lang_pred", pa.string()), ("score", pa.float64())], make)


def keep_known(df: DataFrame, profiles: Profiles, least_score: float, text: str = "text") -> DataFrame:
    """The rows whose text is in a learned language (not ``und``, at least
    ``least_score``), with all their columns."""

    def run(batches):
        at = names.index(text)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = map(profiles.predict, part.column(at).to_pylist())
                yield part.filter(pa.array([lang != "und" and score >= least_score for lang, score in found]))

    names = df.columns
    return small_batches(df).mapInArrow(run, df.schema)
