"""The queries ``opN_<name>`` of the training-data operators, and their SQL.

Each applies its operator with production parameters to its whole table and
derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.embedding_dedup import near_links

    return near_links(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_prefix import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), threshold=75)


HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(f"not ({HELD_OUT})"))
    return identify(docs, profiles).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"), revisit_from=0).drop("url")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import judge

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(table(spark, sf_dir, "documents")).select(columns)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import digests, expand, format_turns
    from tidemark.llm.common import materialize

    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string"))
    turns = materialize(format_turns(rows), "chat")
    return digests(turns, materialize(expand(turns), "examples"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), digests=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack, word_encoder

    path = vocabulary("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), lambda: word_encoder(path, end=2), digests=True)


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_REACH = """
    e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT id AS u, id AS root FROM ids UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u),
    c AS (SELECT u AS id, min(root) AS component_id FROM r GROUP BY u)
"""

_SQL = {
    "op1_ngram_join": r"""
        WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents),
        w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    """ + _REACH + """, m AS (SELECT u, count(*) AS n FROM e GROUP BY u),
        q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS whole FROM s GROUP BY doc_id))
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(q.class_id, d.doc_id) AS class_id, coalesce(m.n, 0) AS n_links
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN m ON m.u = d.doc_id JOIN c ON c.id = d.doc_id""",
    "op3_embedding_dedup": """
        WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
        x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR isnan(q) OR isinf(q))) = 0 AND len(list_filter(embedding, lambda q: q <> 0)) > 0),
        l AS (SELECT y.vec_id AS a, z.vec_id AS b FROM x y JOIN x z ON y.vec_id < z.vec_id WHERE list_cosine_similarity(y.v, z.v) >= 0.9),
    """ + _REACH + """, m AS (SELECT u, count(*) AS n FROM e GROUP BY u)
        SELECT i.id AS vec_id, coalesce(m.n, 0) AS n_links, c.component_id, i.id = c.component_id AS kept FROM ids i LEFT JOIN m ON m.u = i.id JOIN c ON c.id = i.id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        h AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hex, max(page_id) OVER (PARTITION BY sha1(t)) AS top FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM h""",
    "op10_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        x AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|<\|(role|text|end)\|>')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 23 + length(role) END AS n FROM t),
        y AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM x)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant' OR back = 1) AS n_examples
        FROM y GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are held against brute force, libraries or held-out labels in the tests."""
    return {k: " ".join(v.split()) if "'\\'" not in v else v for k, v in _SQL.items()}
