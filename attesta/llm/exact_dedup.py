"""Exact dedup by a heavy-hitter split.

Digests of all texts are written once. A Misra-Gries summary (the mergeable counters behind ``freqItems``) names every
digest that may hold more than ``support`` of the rows; an exact count verifies them. The winners, at most
``1 / support`` rows whatever the input, are broadcast, and their rows are settled map-side. All other digests are
shuffled in the ordinary way: none of them has more than ``support`` of the rows, so no task gets a hot group.

Defined results: a null text counts as empty; of equal texts the largest doc_id stays (null ids are smallest); of rows
that repeat both id and text exactly one stays; an empty table gives an empty result; other columns are ignored by
:func:`exact_groups` and passed on by :func:`drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, checked_broadcast, fresh_names

#: Least share of all rows that makes a digest hot; also bounds the broadcast to 10,000 digests.
SUPPORT = 1e-4


def _digests(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    return scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def heavy_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, best, n)`` of the digests with at least ``support`` of the rows, counted exactly."""
    least = max(2, int(support * digests.count()))
    named = digests.select(F.hex("digest").alias("hex")).freqItems(["hex"], support)
    named = named.select(F.explode("hex_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    return (
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )


def _settled(digests: DataFrame, scratch: Scratch, support: float) -> DataFrame:
    heavy = F.broadcast(scratch.keep(heavy_digests(digests, support)))  # at most 1 / support rows
    same = W.partitionBy("digest")
    rest = digests.join(heavy.select("digest"), "digest", "left_anti").select(
        "doc_id", "row", "digest", F.max(F.struct("doc_id", "row")).over(same).alias("best"), F.count("*").over(same).alias("n")
    )
    return digests.join(heavy, "digest").select("doc_id", "row", "digest", "best", "n").unionByName(rest)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = scratch or Scratch(docs.sparkSession)
    return _settled(_digests(docs, id_col, text_col, scratch), scratch, support).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the rows to drop are joined back. Rows that repeat id and text cannot be told apart by these, so of each such
    pair the join drops all and one is put back by a window over these pairs alone.
    """
    scratch = Scratch(docs.sparkSession)
    stays = (F.col("row") == F.col("best.row")).alias("stays")
    settled = scratch.keep(_settled(_digests(docs, id_col, text_col, scratch), scratch, support).where("n > 1").select("doc_id", "digest", stays))
    pairs = scratch.keep(settled.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("n > 1 OR NOT stays"))
    scratch.only(pairs)
    key, number = fresh_names(docs, "digest", "number")
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))

    def on(side: DataFrame):
        return (keyed[id_col].eqNullSafe(side["doc_id"])) & (keyed[key] == side["digest"])

    gone = checked_broadcast(pairs.select("doc_id", "digest"))
    out = keyed.join(gone, on(gone), "left_anti")
    again = pairs.where("n > 1 AND stays").select("doc_id", "digest")
    if not again.isEmpty():
        again = checked_broadcast(again)
        first = W.partitionBy(key, id_col).orderBy(F.lit(1))
        out = out.unionByName(keyed.join(again, on(again), "left_semi").withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number))
    return out.drop(key)
