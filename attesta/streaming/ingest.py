"""Incremental ingest: a file stream of documents, chunked and appended exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.chunk import chunk_fixed, numbered
from attesta.sources.index import Index
from attesta.sources.store import Store


def ingest_stream(spark: SparkSession, source: str, schema: str, store: Store | Index, checkpoint: str, *, size: int = 512, overlap: int = 50):
    """Start a query that takes new Parquet files of (id, text, …) once and adds documents and chunks to the store.

    ``store`` may be an :class:`attesta.sources.index.Index`, which then embeds and indexes the chunks. Each micro-batch
    appends its own rows alone. Replays add nothing: ids are derived from document and chunk number, and keys that are
    there are skipped.
    """

    def chunks_of(batch: DataFrame) -> DataFrame:
        return numbered(chunk_fixed(batch, size, overlap).drop("chunk_number"))

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["id"])
        if isinstance(store, Index):
            store.add_documents(batch, chunks_of)
        else:
            store.add("documents", batch.withColumnRenamed("text", "raw_content"))
            store.add_chunks(chunks_of(batch))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, ident: str = "id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows of a stream without those that repeat an id within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])


def stage_rows(answers: DataFrame, elapsed_ms: Column | None = None) -> DataFrame:
    """Answers (question_id, documents, highlights, answer[, error]) as staged rows (question_id, seq, type, payload).

    Documents, progress, highlights, answer. An answer without documents that ended early (column ``ended``) is a single
    answer; one with an ``error`` is its documents and the error.
    """
    has = set(answers.columns)
    early = F.coalesce(F.col("ended"), F.lit(False)) if "ended" in has else F.lit(False)
    failed = F.col("error").isNotNull() if "error" in has else F.lit(False)
    took = F.coalesce(elapsed_ms, F.lit(0)) if elapsed_ms is not None else F.lit(0)
    row = lambda seq, kind, payload, keep: F.when(keep, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), payload.alias("payload")))
    done = F.lit(True).alias("done")
    stages = F.array_compact(F.array(
        row(0, "documents", F.to_json(F.struct("documents")), ~early),
        row(1, "progress", F.to_json(F.struct(F.lit("extraction_complete").alias("stage"), took.cast("bigint").alias("elapsed_ms"))), ~early & ~failed),
        row(2, "highlights", F.to_json(F.struct("highlights")), ~early & ~failed),
        row(3, "error", F.to_json(F.struct((F.col("error") if "error" in has else F.lit(None).cast("string")).alias("error"), done)), failed),
        row(3, "answer", F.to_json(F.struct("answer", done)), ~failed),
    ))
    return answers.select("question_id", F.explode(stages).alias("s")).select("question_id", "s.*")


def latest_stage(stages: DataFrame) -> DataFrame:
    """What a client holds after all stages: the last payload of each type."""
    return stages.groupBy("question_id").agg(*[F.max_by("payload", F.when(F.col("type") == t, F.col("seq"))).alias(t) for t in ("documents", "highlights", "answer")])


def collected_stages(stages: DataFrame) -> dict:
    """Stages on the driver, a list for each question in order; for small sets of questions."""
    out: dict = {}
    for r in stages.orderBy("question_id", "seq").toLocalIterator():
        out.setdefault(r.question_id, []).append((r.type, r.payload))
    return out


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line, files in the order of the rows' partitions; without rows, one line that says so."""
    if rows.isEmpty():
        rows = rows.sparkSession.createDataFrame([("error", "no rows", True)], "type string, error string, done boolean")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
