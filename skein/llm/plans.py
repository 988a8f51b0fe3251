"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, exact, langid, merkle, packing, pii, polytope, quality, quotes, simhash, sql, tokencount, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: vocabulary file of the packing query
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op1_decontaminate")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_pack")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER)


@query("op8_language")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


@query("op2_personal_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN strlen(html) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(html) >= 100 AND page_id > first THEN first END AS refers_to
    FROM f
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_edited_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    trees = tokencount.build_trees(table(spark, folder, "documents"), *how)
    edited = tokencount.apply_edits(trees.withColumn("edits", tokencount.sample_edits()), *how)
    return edited.select("doc_id", "tokens_before", "tokens_after", "chars_recoded", "nodes_written")


@query("op7_quotes")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(quotes.as_mail(table(spark, folder, "conversations")))


@query("op11_merkle_manifest", sql.MERKLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audited(table(spark, folder, "documents"))


@query("op12_prefix_trie", sql.TRIE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefixes(table(spark, folder, "conversations"))


@query("op13_near_vectors", sql.NEAR_VECTORS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return polytope.near_vectors(table(spark, folder, "embeddings"))
