import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, ngram_join, warc
from tidemark.llm.common import shared_uri
from tidemark.llm.components import components

SCHEMA = "doc_id bigint, text string, n bigint, rep string"


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(n)]


def corpus():
    rng, rows = random.Random(8), []
    passage = words(rng, 60)
    for _ in range(40):
        rows.append(words(rng, rng.randint(1, 120)))
    for _ in range(60):  # share a passage, and are no near duplicates
        own = words(rng, rng.randint(40, 200))
        rows.append(own[:20] + passage + own[20:])
    for size in (2, 3, 30, 120):  # near copies, some of them chains
        base = words(rng, rng.randint(20, 150))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            if rng.random() < 0.3:
                base = copy
            rows.append(copy)
    rows += [["only", "four", "words", "here"]] * 3 + [["ONLY", "four", "Words", "here"], ["only", "four", "words"]]
    texts = [" ".join(r) for r in rows] + [None, "", "  \n", "x " * 3000, "x " * 3001]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("heavy, few, block, leaf", [(1 << 18, 1024, 2048, 64), (0, 4, 2048, 3), (1 << 18, 0, 9, 3), (0, 0, 2048, 2)])
def test_join_equals_brute_force(spark, monkeypatch, heavy, few, block, leaf):
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "HEAVY_KEYS", heavy)
    monkeypatch.setattr(ngram_join, "HEAVY_FROM", 8)
    texts = corpus()
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in texts.items()], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == ngram_join.brute_force(texts)


def thue_morse(steps):
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("steps", [3, 4, 6, 10, 12])
def test_regular_words_do_not_collide(steps):
    one = thue_morse(steps)
    other = one.translate(str.maketrans("ab", "ba"))
    for hashes in (ngram_join.WordHasher(), ngram_join.WordHasher(fold_case=True)):
        assert hashes(one)[0] != hashes(other)[0]
        assert not len(np.intersect1d(ngram_join.shingles(f"u {one} v w x", hashes), ngram_join.shingles(f"u {other} v w x", hashes)))


def test_regions_divide_and_keep_links(spark):
    """Two groups of copies in one region: pivots divide them, and the forest connects what brute force does."""
    import pandas as pd
    import zstandard

    rng, hashes, press = random.Random(12), ngram_join.WordHasher(fold_case=True), zstandard.ZstdCompressor().compress
    texts = {}
    for group in range(3):
        base = words(rng, 80)
        for k in range(70):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(80)] = words(rng, 1)[0]
            texts[100 * group + k] = " ".join(copy)
    sets = {k: ngram_join.shingles(t, hashes) for k, t in texts.items()}
    pdf = pd.DataFrame([(k, len(sets[k]), k, True, True, ngram_join.sketch(sets[k]), press(t.encode())) for k, t in texts.items()], columns=["rep", "n", "comp", "asks", "base", "sketch", "z"])
    region, leaves = ngram_join._Region(pdf, 75), []
    leaf = region.leaf
    region.leaf = lambda idx: (leaves.append(len(idx)), leaf(idx))
    ties = region.join()
    assert len(leaves) > 1 and max(leaves) < len(texts)
    want = ngram_join.brute_force(texts)
    comp = {k: k for k in texts}
    for _ in texts:
        for a, b in ties.tolist():
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert comp == {k: c for k, (_, c) in want.items()} and len(ties) < len(texts)


def test_join_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1, ""), (5, "a b c d e f", 1, ""), (None, "a b c d e f", 1, ""), (3, "a b c d e f", 1, ""), (9, None, 1, "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, few", [(2048, 200), (16, 0), (16, 10**9)])
def test_join_counts_every_link(spark, monkeypatch, block, few):
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    monkeypatch.setattr(ngram_join, "LINK_FEW", few)
    monkeypatch.setattr(ngram_join, "LINK_COLUMNS", 64)
    texts = corpus()
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for k, t in texts.items() for w in [(t or "").lower().split()]}
    want = {k: sum(j != k and 100 * len(s & x) >= 75 * len(s | x) > 0 for j, x in sets.items()) for k, s in sets.items()}
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in texts.items()] + [(0, texts[0], 1, "r")], SCHEMA).repartition(3)
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_classes(df).collect()}
    assert got == want and max(want.values()) == 20


def test_sketches_never_rule_out_a_link():
    rng, hashes = random.Random(9), ngram_join.WordHasher(fold_case=True)
    for _ in range(300):
        a = words(rng, rng.randint(5, 400))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            b[rng.randrange(len(b))] = words(rng, 1)[0]
        if rng.random() < 0.5:
            b += words(rng, rng.randint(0, len(b) // 3))
        x, y = (ngram_join.shingles(" ".join(w), hashes) for w in (a, b))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            assert ngram_join._may_link(ngram_join.sketch(x), ngram_join.sketch(y), len(x), len(y))


def test_window_is_exact():
    for n in range(1, 400):
        least = next(k for k in range(n + 1) if 100 * k >= 75 * n)
        assert ngram_join.window(n) == n - least + 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000), (None, 1)]
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {k: root(k) for k in comp}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = base.tolist()
    for k in range(400):  # partners from just above the threshold on
        q, g = base[k], rng.normal(size=64)
        g -= g @ q * q
        c = rng.uniform(0.9005, 0.99)
        rows.append((3 * (c * q + np.sqrt(1 - c * c) * g / np.linalg.norm(g))).tolist())
    rows += [rows[0]] * 5 + [None, [0.0] * 64, [float("nan")] * 64, [1.0] * 63, [float("inf")] + [0.0] * 63, [1e30] * 64, [2e30] * 64]
    vectors = dict(enumerate(rows))
    df = spark.createDataFrame([*vectors.items()], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_links(df).collect()}
    fine = [k for k, v in vectors.items() if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)]
    x = np.array([np.array(vectors[k]) / np.linalg.norm(vectors[k]) for k in fine])
    want = (x @ x.T >= 0.9).sum(1) - 1
    found = np.array([got[k].n_links for k in fine])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert all(got[k].n_links == 0 and got[k].kept for k in vectors if k not in fine)
    assert all(r.kept == (r.component_id == r.vec_id) and r.component_id <= r.vec_id for r in got.values())
    assert got[1900].component_id == 0 and got[1900].n_links >= 5
    assert embedding_dedup.near_links(df.limit(0)).count() == 0
    assert [r.n_links for r in embedding_dedup.near_links(df.where("vec_id < 2")).collect()] == [0, 0]


def test_small_embeddings_equal_brute_force(spark):
    rows = {1: [1.0, 0.0], 2: [2.0, 0.1], 3: [0.0, 1.0], 4: None, 5: [1.0, 0.4], 6: [1.0, 0.0], 7: [1.0, None]}
    df = spark.createDataFrame([*rows.items()], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_links(df).collect()}
    rows[7] = None
    assert got == embedding_dedup.brute_force(rows)


def test_archive(spark):
    rng = random.Random(4)
    rows = [(k, f"http://x/{k}", "page " + "".join(rng.choice("abcé\r\n") for _ in range(rng.randint(0, 2000)))) for k in range(120)]
    rows += [(200 + k, "a\r\nb", rows[k % 7][2]) for k in range(20)] + [(300, None, None), (301, "", ""), (302, "z", "q"), (302, "z", "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    made = []
    for parts in (1, 5):  # the same files, however the input lies
        out = shared_uri(spark, "warc")
        made.append(sorted(map(tuple, warc.write_archive(df.repartition(parts), out, roll_bytes=20_000).collect())))
        got = warc.read_archive(spark, out, payloads=True).collect()
    assert made[0] == made[1] and len(made[0]) > 1
    last = {}
    for page, _, text in rows:
        last[text or ""] = max(page, last.get(text or "", -1))
    want = sorted((p, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), *(("response", None) if last[t or ""] == p else ("revisit", last[t or ""]))) for p, _, t in rows[:-1])
    seen = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if not (r.page_id == 302 and r.record_type == "revisit"))
    assert seen == want and len(got) == len(rows)
    whole = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert whole[100] == rows[100][2].encode()
    few = {r.page_id: r.record_type for r in warc.archive_round_trip(df, revisit_from=10**6).where(F.col("page_id") < 300).collect()}
    assert set(few.values()) == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_pipeline_steps(spark):
    import corpus_pipeline

    prose = [" ".join(words(random.Random(k), 80)) for k in range(30)]
    texts = [*prose, prose[0], prose[1] + " end", "", None, "### $$$ " * 50, "1 2 3"]
    df = spark.createDataFrame([(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(range(len(texts))) - {30, 31}) and near.columns == df.columns
    assert corpus_pipeline.near_duplicate_stage(spark, df.unionByName(df), "").count() == near.count()
    known = corpus_pipeline.language_stage(spark, df, "")
    assert {r.doc_id for r in known.collect()} == set(range(32)) and known.columns == df.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_join", "packing"]
