"""Quality rules by weak supervision.

Nine rules look at a text's statistics and vote good (1), bad (-1) or abstain
(0).  Expectation-maximisation over the counts of vote patterns (3**9 at most,
whatever the corpus) estimates how each rule that does not abstain votes on
good and on bad texts; an abstention is no evidence.  The posterior probability of good, not all-must-pass filtering, decides.

Statistics are exact over whole texts; EM sees the counts of all of them.
Defined cases: null and empty texts have no words and fail the base rule;
repeated rows each count; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import PIECE_BYTES, WordHasher, materialize, small_batches, white_chars, window_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Of each rule: the statistic, bad below, good from, good to, bad above.
RULES: dict[str, tuple[float, float, float, float]] = {
    "length": (10, 20, float("inf"), float("inf")),
    "word_length": (2.5, 3.0, 10.0, 12.0),
    "symbols": (-1, 0, 0.02, 0.1),
    "symbol_chars": (-1, 0, 0.01, 0.04),
    "dup_lines": (-1, 0, 0.1, 0.3),
    "repeats": (-1, 0, 0.05, 0.2),
    "letters": (0.75, 0.9, 1, 2),
    "digits": (-1, 0, 0.1, 0.3),
    "variety": (0.6, 1.2, float("inf"), float("inf")),
}
#: A text is kept from this posterior probability on.
KEEP_FROM = 0.5

_KINDS = [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_digits", "n_kinds")]


def text_stats(text: str | None, hashes: WordHasher) -> tuple[int, ...]:
    """The statistics in the order of the columns that :func:`stats` gives."""
    h = hashes(text)
    n = len(h)
    if not n:
        return (0,) * len(_KINDS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeat = 0
    if n > WINDOW:
        windows = window_hashes(h, WINDOW)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(WINDOW):
                covered[k : k + len(twice)] |= twice
            repeat = int(covered.sum())
    digits = letters = 0
    for at in range(0, len(text), PIECE_BYTES):
        raw = np.frombuffer(text[at : at + PIECE_BYTES].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = raw | 32
        digits += int(((raw >= 48) & (raw <= 57)).sum())
        letters += int(((low >= 97) & (low <= 122) | (raw >= 0xC0)).sum())
    return n, len(text) - white_chars(text), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), letters, digits, len(np.unique(h))


def stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    from tidemark.llm.token_prefix import _mapped

    def make():
        hashes = WordHasher()
        return lambda ids, texts: [ids, *zip(*[text_stats(x, hashes) for x in texts], strict=True)]

    return _mapped(df, key, text, _KINDS, make)


def _measures(of: str = "") -> dict[str, Column]:
    col = lambda name: F.col(of + name)
    share = lambda a, b: col(a) / F.greatest(col(b), F.lit(1))
    return {
        "length": col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "symbol_chars": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "letters": share("n_letters", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        # distinct words against what a text of this length has at least: long texts repeat words
        "variety": col("n_kinds") / F.pow(F.greatest(col("n_words"), F.lit(1)), F.lit(0.75)),
    }


def base_failed(of: str = "") -> Column:
    return (F.col(of + "n_words") < 10) | (100 * F.col(of + "n_repeat_words") > 20 * F.col(of + "n_words"))


def votes(of: str = "") -> Column:
    """All rules' votes as one number in base 3 (bad 0, abstain 1, good 2)."""
    out = F.lit(0)
    for name, m in _measures(of).items():
        bad_below, good_from, good_to, bad_above = RULES[name]
        vote = F.when((m < bad_below) | (m > bad_above), 0).when((m >= good_from) & (m <= good_to), 2).otherwise(1)
        out = out * 3 + vote
    return out.cast("int")


def fit(patterns: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """EM over pattern counts: the posterior of good for each pattern."""
    if not patterns:
        return {}
    r = len(RULES)
    codes = np.array(sorted(patterns))
    weight = np.array([patterns[c] for c in codes], float)
    vote = codes[:, None] // 3 ** np.arange(r - 1, -1, -1)[None] % 3
    # to begin with, any bad vote counts for more than all good ones: rules that find fault speak up seldom
    post = np.where((vote == 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((weight * post).sum() / weight.sum(), 0.05, 0.95)
        log = np.zeros((len(codes), 2))
        for k, p in enumerate((1 - post, post)):
            for j in range(r):
                # a few votes of prior belief: good texts get good votes, bad texts bad ones
                held = np.array([(weight * p)[vote[:, j] == v].sum() for v in (0, 2)]) + ((2.0, 0.2) if k == 0 else (0.2, 2.0))
                bad, good = np.log(held / held.sum())
                log[:, k] += np.array([bad, 0, good])[vote[:, j]]  # an abstention tells nothing
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1] + np.log((1 - prior) / prior), -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def posterior(seen: DataFrame, name: str) -> DataFrame:
    """``name`` and quality of each vote pattern that occurs: 3**9 rows at most."""
    counts = {r[0]: r[1] for r in seen.groupBy(name).count().collect()}
    return seen.sparkSession.createDataFrame([*fit(counts).items()], f"{name} int, quality double")


def keep_good(df: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows that pass, with all their columns and without a shuffle of texts.
    Statistics are computed once, beside the rows, which are written with their votes."""
    tag = next(t for k in range(2, 100) if not any(c.startswith(t := "_" * k + "quality_") for c in df.columns))
    at, names = df.columns.index(text), [tag + k for k, _ in _KINDS]

    def run(batches):
        hashes = WordHasher()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = zip(*[text_stats(x, hashes) for x in part.column(at).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in found)], [*part.schema.names, *names])

    schema = StructType([*df.schema.fields, *(StructField(x, LongType()) for x in names)])
    seen = small_batches(df).mapInArrow(run, schema).withColumn(f"{tag}votes", votes(tag)).withColumn(f"{tag}failed", base_failed(tag)).drop(*names)
    seen = materialize(seen, "judged")
    good = posterior(seen, f"{tag}votes").where(F.col("quality") >= keep_from).drop("quality")
    return seen.where(~F.col(f"{tag}failed")).join(F.broadcast(good), f"{tag}votes", "left_semi").select(df.columns)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``key``, the statistics, base_failed, votes, quality (posterior) and kept."""
    seen = materialize(stats(df, key, text).withColumn("votes", votes()), "quality")
    out = seen.join(F.broadcast(posterior(seen, "votes")), "votes").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
