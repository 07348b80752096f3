"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. The index is a list of runs, each a table of ``(line hash, owner)``
bucketed and sorted by hash; runs hold disjoint hashes. A batch is first reduced to one row per hash (partial
aggregation before its only shuffle), then merge-joined with every run on their common bucketing, so runs are never
shuffled; the join keeps the owners that runs know, and the hashes that no run has, its anti-join, become the batch's own
run. When a level has ``FANOUT`` runs they are compacted into one run of the next level. As batches ascend, the owner of
a hash is the smallest doc_id that holds it.

The index goes when the call ends, or stays under the name that the caller gives it: later calls then take up its runs,
and lines that an earlier call has seen are lost by the new documents, whatever their doc_ids.

Lines are settled against the batch's own table: hashes with over ``HOT_SHARE`` of the batch's lines (at most
``1 / HOT_SHARE``) by broadcast, the rest by a shuffle on the hash. Only dropped positions travel to the documents.

Defined results: null or empty text is one empty line; a null doc_id owns no line and loses none; rows that repeat a
doc_id are one document when lines are counted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import ASCII_SPACE, Scratch, ascii_lower, let

#: Batches of one full pass; runs of a level before they are compacted; least code points of a key; share of a hot hash.
BATCHES, FANOUT, LEAST, HOT_SHARE = 4, 3, 10, 1e-3


def line_key(line):
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


class Runs:
    """The levelled index. Tables live in the session's warehouse, which all executors share.

    With a ``name`` its levels are listed in a table of that name, written anew after each change and read at the start.
    """

    def __init__(self, spark, buckets: int, fanout: int = FANOUT, name: str | None = None):
        self.spark, self.buckets, self.fanout, self.name = spark, buckets, fanout, name
        self.stem, self.levels, self.listed = f"attesta_run_{name or uuid.uuid4().hex}", [], []
        if name and spark.catalog.tableExists(f"{self.stem}_levels"):
            for r in spark.table(f"{self.stem}_levels").orderBy("level", "table").collect():
                self.levels += [[] for _ in range(r.level + 1 - len(self.levels))]
                self.levels[r.level].append(r.table)
            self.buckets = spark.table(f"{self.stem}_levels").first().buckets

    def _write(self, df: DataFrame) -> str:
        table = f"{self.stem}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").saveAsTable(table)
        return table

    def _fresh(self, table: str) -> DataFrame:
        return self.spark.table(table).where("fresh").select("h", "owner")

    def add(self, keys: DataFrame) -> str:
        """Merge-join ``keys (h, first, last, n)`` with every run; the joined table, whose ``fresh`` rows are a new run."""
        found = []
        for i, table in enumerate(t for level in self.levels for t in level):
            keys = keys.join(self._fresh(table).withColumnRenamed("owner", f"__o{i}"), "h", "left")
            found.append(F.col(f"__o{i}"))
        owner = F.coalesce(*found, F.lit(None).cast("bigint"))
        table = self._write(keys.select("h", F.coalesce(owner, "first").alias("owner"), owner.isNull().alias("fresh"), (owner.isNotNull() | (F.col("first") < F.col("last"))).alias("repeats"), "n"))
        self.levels = self.levels or [[]]
        self.levels[0].append(table)
        return table

    def compact(self) -> None:
        """Merge the runs of each full level; afterwards nothing may read the tables that :meth:`add` gave."""
        done = []
        for at, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = reduce(DataFrame.unionByName, (self._fresh(t).withColumn("fresh", F.lit(True)) for t in level))
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(merged.repartition(self.buckets, "h")))
            done += level
            self.levels[at] = []
        if self.name:
            rows = [(i, t, self.buckets) for i, level in enumerate(self.levels) for t in level]
            self.spark.createDataFrame(rows, "level int, table string, buckets int").coalesce(1).write.mode("overwrite").saveAsTable(f"{self.stem}_levels")
        self._drop(done)

    def close(self) -> None:
        """Drop the tables, unless the index has a name."""
        if not self.name:
            self._drop([t for level in self.levels for t in level])

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def dropped_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, index: str | None = None) -> DataFrame:
    """``(doc_id, th, gone)``: positions of the lines that each document loses; ``th`` tells apart rows of one doc_id."""
    spark = docs.sparkSession
    ids = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first().q or []
    batch = reduce(lambda a, q: a + (F.col("doc_id") > F.lit(q)).cast("int"), ids, F.lit(0))
    lines = (
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "th", "pos", line_key("line").alias("key"))
        .where(F.length("key") >= LEAST)
        .select("doc_id", "th", "pos", F.unhex(F.md5("key")).alias("h"), batch.alias("batch"))
    )
    lines = scratch.keep(lines, by=["batch"])
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), name=index)
    gone = []
    for b in range(len(ids) + 1):
        part = lines.where(F.col("batch") == b).drop("batch")
        keys = part.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        settled = spark.table(runs.add(keys)).where("repeats").select("h", "owner", "n")
        hot_at = max(100, int(HOT_SHARE * part.count()))
        hot = F.broadcast(settled.where(F.col("n") > hot_at).select("h", "owner"))  # at most 1 / HOT_SHARE rows
        rest = settled.where(F.col("n") <= hot_at).select("h", "owner")
        cold = part.join(hot.select("h"), "h", "left_anti")
        drops = part.join(hot, "h").unionByName(cold.join(rest, "h")).where("owner <> doc_id")
        gone.append(scratch.keep(drops.groupBy("doc_id", "th").agg(F.array_distinct(F.collect_list("pos")).alias("gone"))))
        runs.compact()
    runs.close()
    return reduce(DataFrame.unionByName, gone)  # a document is in one batch


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, index: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, kept text, n_lines, n_dropped. ``index``: name of an index to take up and keep."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = dropped_lines(docs, scratch, batches, index)
    lines = F.split("text", "\n")
    left = lambda w: F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, lambda w: F.array_join(F.transform(left(w), lambda i: F.get(w, i)), "\n")))
    return (
        docs.withColumn("th", F.xxhash64("text"))
        .join(gone, ["doc_id", "th"], "left")
        .select("doc_id", kept.alias("text"), F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
    )
