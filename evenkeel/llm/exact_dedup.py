"""Exact duplicates, with frequent digests split off.

A Misra-Gries summary (Spark's ``approx_top_k`` keeps one per task and merges them) names the digests that may be
frequent. Their exact count and first row come from one aggregate over the rows that carry them; these verified
winners are broadcast and settle their rows without a shuffle. All other digests are shuffled as usual. Rows to drop are
named by digest and id and dropped where they are read, so digests move and texts do not, as long as the names of the
rows to drop (winners' rows aside) can be broadcast; more are joined by shuffle.

NULL text is the empty text. Of equal texts the row with the smallest id stays, a NULL id counts as the largest, and
of repeated rows with one id exactly one stays. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import common

#: Counters of the Misra-Gries summary, which bound its error; a frequent digest that it misses is shuffled as others are.
TRACKED = 100_000
#: Digests that are settled by broadcast at most: about 150 bytes each.
WINNERS = 2_000
#: Rows to drop that may be broadcast, about 150 bytes each.
BROADCAST_ROWS = 200_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: the only pass over the texts."""
    texts = common.text_of(docs, id_col, text_col)
    return texts.select("doc_id", common.digest(F.col("text")).alias("digest"))


def winners(rows: DataFrame, tracked: int = TRACKED, most: int = WINNERS) -> DataFrame:
    """The frequent digests with exact count and first row: ``digest, group_size, first``; at most ``most`` rows."""
    summary = rows.agg(F.expr(f"approx_top_k(digest, {int(most)}, {int(tracked)})").alias("top"))
    candidates = summary.select(F.explode("top.item").alias("digest"))
    verified = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("first"))
    )
    return verified.where("group_size > 1")


def _order():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))


def judged(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``doc_id, row, digest, group_size, first, hot`` for the staged ``doc_id, row, digest``, given the winners."""
    settled = rows.join(F.broadcast(hot), "digest", "left")
    by_broadcast = settled.where("group_size IS NOT NULL").withColumn("hot", F.lit(True))
    same = Window.partitionBy("digest")
    by_shuffle = (
        rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("first", F.min(_order()).over(same))
        .withColumn("hot", F.lit(False))
    )
    return by_broadcast.unionByName(by_shuffle).withColumn("kept", F.col("first.row") == F.col("row"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, most: int = WINNERS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = digests(docs, id_col, text_col).withColumn("row", common.row_key())
    rows = common.stage(rows, "digests")
    hot = common.stage(winners(rows, tracked, most), "winners")
    return judged(rows, hot).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        "kept",
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, most: int = WINNERS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Digests are grouped first, without the texts. Then the texts are read again, and rows that go are left out there:
    those of winners by the broadcast winners, others by digest and id.
    """
    rows = digests(docs, id_col, text_col).withColumn("row", common.row_key())
    rows = common.stage(rows, "digests")
    hot = common.stage(winners(rows, tracked, most), "winners")
    # of rows with equal text and id all stay or go here
    named = judged(rows, hot).where("group_size > 1").groupBy("digest", "doc_id", "hot")
    named = common.stage(named.agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("copies")), "judged")

    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.col(f"`{id_col}`").alias("doc_id"),
        common.digest(common.whole_text(text_col)).alias("digest"),
    )
    winner = F.broadcast(hot.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(True).alias("known")))
    left = whole.join(winner, "digest", "left").where("known IS NULL OR doc_id <=> keep_id").select("whole", "doc_id", "digest")

    def names(some: DataFrame) -> tuple[DataFrame, object]:
        named_so = some.select(F.col("digest").alias("its_digest"), F.col("doc_id").alias("its_id"))
        few = named_so.count() <= broadcast_rows
        on = (F.col("digest") == F.col("its_digest")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
        return F.broadcast(named_so) if few else named_so, on

    left = left.join(*names(named.where("NOT kept AND NOT hot")), "left_anti")
    repeated = named.where("kept AND copies > 1")
    if not repeated.isEmpty():
        which, on = names(repeated)
        once = left.join(which, on, "left_semi").dropDuplicates(["digest", "doc_id"])
        left = left.join(which, on, "left_anti").unionByName(once)
    return left.select("whole.*")
