"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from evenkeel.llm import (
    ann, bpe, exact_dedup, fim, html, license_scan, near_dedup, negatives, packing, pii, sharding, topk, toxicity,
)
from evenkeel.llm.common import table


#: Of these queries only; whoever replaces real data brings a secret of their own.
KEY = b"a key for the queries on invented data"


def op1_packing(spark, sf_dir):
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN).drop("ids")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_main_text(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages")).drop("path")


def op4_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark, sf_dir):
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_surrogates(spark, sf_dir):
    rows = pii.pseudonymized(table(spark, sf_dir, "documents"), KEY)
    return rows.select("whole.doc_id", "text", F.col("n").alias("n_mentions"))


def op9_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    rows = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"),
    )


def op12_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_exact_dedup, op3_main_text, op4_top_k, op5_toxicity, op6_sharding, op7_near_dedup,
        op8_surrogates, op9_bpe, op10_license_scan, op11_fill_in_middle, op12_nearest, op13_hard_negatives,
    )
}

ORACLE = {
    "op2_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
""",
    "op4_top_k": topk.ORACLE,
    "op10_license_scan": license_scan.oracle_sql(),
    "op11_fill_in_middle": fim.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
