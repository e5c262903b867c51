"""Byte-level BPE: texts to ids by a local rank file, and ids back to raw bytes.

Ids are binary columns of little-endian unsigned 32-bit integers. A NULL text is the empty text; it has no ids, and no
ids decode to no bytes. A NULL in a binary column decodes to no bytes too. Decoding never assumes valid UTF-8.
Each executor reads the rank file from its own path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.llm import common, tokens


def encode(text: Column, path: str, pattern: str) -> Column:
    """Binary ids of whole texts."""

    def run(batches):
        encoder = tokens.rank_encoder(path, pattern)
        for batch in batches:
            yield pa.array([ids for some in tokens.slices(batch.fill_null("")) for ids in encoder(some)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes of binary ids."""

    def run(batches):
        known = tokens.vocabulary(path, pattern)
        for batch in batches:
            yield pa.concat_arrays([pa.array([], pa.binary()), *(tokens.decoded(some, known) for some in tokens.slices(batch))])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids, n_tokens``."""
    rows = common.text_of(docs, id_col, text_col).select("doc_id", encode(F.col("text"), path, pattern).alias("ids"))
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, decoded``: the ids and the bytes they stand for.

    Both ways are taken in one pass, by one worker for each task, and rows leave it a few million bytes of text at a time.
    """

    def run(batches):
        encoder, known = tokens.rank_encoder(path, pattern), tokens.vocabulary(path, pattern)
        for batch in tokens.small_batches(batches, "text"):
            ids = pa.array(encoder(batch.column("text")), pa.binary())
            counts = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
            made = [batch.column("doc_id"), ids, counts, tokens.decoded(ids, known)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "ids", "n_tokens", "decoded"])

    texts = common.text_of(docs, id_col, text_col)
    schema = StructType([texts.schema["doc_id"]]).add("ids", "binary").add("n_tokens", "long").add("decoded", "binary")
    return texts.mapInArrow(run, schema)
