"""The corpus pipeline: language, quality, near duplicates, packing.

Each stage takes the documents that its predecessor kept and applies one
operator of ``tidemark.llm`` with its production parameters; what the operator
rejects is gone.  ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, ngram_join, packing, quality
from tidemark.llm.common import materialize
from tidemark.llm.queries import vocabulary

#: Below this score a text is far from every language's profile (that of prose is 0.4 to 0.8).
LEAST_LANGUAGE_SCORE = 0.25


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters go."""
    return language.keep_known(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are good with a probability of a half or more."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of repeated rows one."""
    classes = ngram_join.jaccard_classes(docs, links=False)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not repeated.limit(1).count():
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    path = vocabulary("word_bpe_49k.json")
    return packing.pack(docs, lambda: packing.word_encoder(path, end=2))


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("ngram_join", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
