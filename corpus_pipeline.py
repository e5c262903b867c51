"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

In every stage a NULL text is handled as the empty text and stays NULL where it stays; texts may be empty or of any length. A
NULL id is an id of its own, larger than all others. Rows are handled by their columns alone, so any order and partitioning of
a table gives the same result. An empty table gives an empty one. All stages but the last return the columns of
``documents``; columns beyond these five stay until the fourth stage and are never looked at, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import exact_dedup, near_dedup, packing, pii, toxicity
from evenkeel.llm.common import stage, table
from evenkeel.llm.queries import KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; empty and NULL texts score as a text without toxic windows. Repeated rows score alike
    and go or stay together. Without labels nothing goes."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the one with the smallest id stays, of rows with equal ids exactly one. NULL equals
    the empty text."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one with the smallest id stays, of rows with equal ids exactly one. Texts without words are
    alike only if they are identical, NULL to the empty text."""
    return near_dedup.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; ``n_chars`` follows. NULL stays NULL, with NULL characters; equal texts stay equal."""
    return pii.pseudonymize(docs, KEY).selectExpr("doc_id", "text", "lang", "source", "CAST(char_length(text) AS bigint) AS n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence. An empty or NULL text is its end id alone; rows with equal ids are packed each on its own."""
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, path, ranks, public_tokenizers.PATTERN).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Training, near-duplicates, surrogates and packing can't be told in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
