"""The pipeline as a whole, each stage's rows recomputed document by document."""

from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_text import plain_posterior, plain_votes
from tidemark.llm import language, ngram_join, quality

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    profiles = language.fit(docs)
    found = {k: profiles.predict(t) for k, t in left.items()}
    left = {k: t for k, t in left.items() if found[k][0] != "und" and found[k][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    known = len(left)
    voted = {k: plain_votes(t) for k, t in left.items()}
    post = plain_posterior(Counter(code for code, *_ in voted.values()))
    left = {k: t for k, t in left.items() if not voted[k][1] and post[voted[k][0]] >= quality.KEEP_FROM}
    good = len(left)
    left = {k: left[k] for k, (_, component) in ngram_join.brute_force(left).items() if component == k}
    assert len(found) >= known > good > len(left) > 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert pieces.keys() == left.keys()
    for k, own in pieces.items():
        ids = np.frombuffer(b"".join(bytes(x) for _, x in sorted(own)), "<u4").tolist()
        assert ids == library.encode(left[k], add_special_tokens=False).ids + [2]


def test_quality_stage_and_packing_stage(spark):
    import corpus_pipeline

    rows = [(1, "one two " * 4, "en", "s", 1), (2, None, None, None, None), (3, "Plain words make up this sentence, which nobody would call bad at all.", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.quality_stage(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {3} and kept.schema == df.schema
    packed = corpus_pipeline.packing_stage(spark, df, "").collect()
    assert Counter(r.doc_id for r in packed).keys() == {1, 2, 3}
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.packing_stage, corpus_pipeline.language_stage):
        assert stage(spark, df.limit(0), "").count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Plain words make up this sentence, which nobody would call bad at all.", 7, 8)], "doc_id bigint, text string, __quality_votes int, n_words int")
    assert [tuple(r)[2:] for r in quality.keep_good(df).collect()] == [(7, 8)]
