"""Labelled question-answer samples: nested files, splits, encoded inputs, losses, metrics and counters."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTENCE = "struct<text:string,relevant:boolean,sentence_id:string>"
SAMPLE = f"question string, documents array<array<{SENTENCE}>>, split string, task_type string, dataset_name string"
METRIC = "epoch int, loss double, precision double, recall double, f1 double, accuracy double"

#: Fixed value: the name of a split in other data sets, and here.
SPLIT_NAMES = {"validation": "dev"}


def seed_everything(seed: int = 42) -> int:
    """Seeds of Python and numpy on the driver; operators take seeds of their own and do not depend on these."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed)
    return seed


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from a JSON array or JSON lines."""
    return spark.read.schema(SAMPLE).option("multiLine", "true").json(path).where("question IS NOT NULL")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.select(*[c.split(" ")[0] for c in SAMPLE.split(", ")]).write.mode("overwrite").json(path)


def load_subsets(spark: SparkSession, paths: dict[str, str], task_type: str = "qa") -> DataFrame:
    """Labelled subsets (id, question, documents, all_relevant_sentence_keys, split), one folder each, as samples.

    A sample without a question or documents is dropped, ``validation`` is called ``dev``, and a sentence is relevant if
    its key is listed.
    """
    out = None
    nested = "id string, question string, documents_sentences array<array<array<string>>>, all_relevant_sentence_keys array<string>, split string"
    for name, path in sorted(paths.items()):
        rows = spark.read.schema(nested).json(path).where("question IS NOT NULL AND documents_sentences IS NOT NULL")
        one = lambda s: F.struct(F.get(s, F.lit(1)).alias("text"), F.coalesce(F.array_contains("all_relevant_sentence_keys", F.get(s, F.lit(0))), F.lit(False)).alias("relevant"), F.get(s, F.lit(0)).alias("sentence_id"))
        part = rows.select("question", F.transform("documents_sentences", lambda d: F.transform(d, one)).alias("documents"), split_name(F.col("split")).alias("split"), F.lit(task_type).alias("task_type"), F.lit(name).alias("dataset_name"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], SAMPLE)
    return out


def split_name(split: Column) -> Column:
    out = split
    for old, new in SPLIT_NAMES.items():
        out = F.when(out == old, new).otherwise(out)
    return out


def of_split(samples: DataFrame, split: str) -> DataFrame:
    if split not in ("train", "dev", "test"):
        raise ValueError(f"unknown split {split!r}")
    return samples.where(F.col("split") == split)


def encode_inputs(samples: DataFrame, tokenise, *, budget: int = 512, special: tuple[int, int] = (1, 2)) -> DataFrame:
    """(question, doc_index, ids, boundaries, labels): a question and the sentences of a document that fit.

    ``tokenise`` gives the ids of a text column. The question comes between two special ids; each sentence follows with
    one at its end, as long as the sum stays within the budget less two. ``boundaries`` are (start, end) of each.
    """
    rows = samples.select("question", F.posexplode("documents").alias("doc_index", "sentences"))
    start, stop = special
    head = F.concat(F.array(F.lit(start)), tokenise(F.col("question")), F.array(F.lit(stop)))
    rows = rows.withColumn("head", head).withColumn("parts", F.transform("sentences", lambda s: F.struct(tokenise(s["text"]).alias("ids"), s["relevant"].alias("relevant"))))

    def step(a: Column, s: Column) -> Column:
        size = F.size(a["ids"])
        fits = a["open"] & (size + F.size(s["ids"]) + 1 <= budget - 2)
        end = F.array(F.struct(size.alias("start"), (size + F.size(s["ids"])).alias("end")))
        return F.struct(F.when(fits, F.concat(a["ids"], s["ids"], F.array(F.lit(stop)))).otherwise(a["ids"]).alias("ids"), F.when(fits, F.concat(a["bounds"], end)).otherwise(a["bounds"]).alias("bounds"), F.when(fits, F.array_append(a["labels"], s["relevant"].cast("int"))).otherwise(a["labels"]).alias("labels"), fits.alias("open"))

    first = F.struct(F.col("head").alias("ids"), F.array().cast("array<struct<start:int,end:int>>").alias("bounds"), F.array().cast("array<int>").alias("labels"), F.lit(True).alias("open"))
    made = rows.select("question", "doc_index", F.aggregate("parts", first, step).alias("x"))
    return made.select("question", "doc_index", "x.ids", F.col("x.bounds").alias("boundaries"), "x.labels")


def padded(encoded: DataFrame, batch: Column, filler: int = 0) -> DataFrame:
    """Rows with ``ids`` and a mask filled to the longest of their batch."""
    most = F.max(F.size("ids")).over(W.partitionBy(batch))
    out = encoded.withColumn("__n", most)
    mask = F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), F.col("__n") - F.size("ids")))
    return out.withColumn("mask", mask).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(filler), F.col("__n") - F.size("ids")))).drop("__n")


def mean_loss(rows: DataFrame, *, loss: str = "loss", document: str = "doc", batch: str = "batch", epoch: str = "epoch") -> DataFrame:
    """Mean loss of an epoch: of its batches' means, of their documents' means, of these's sentences."""
    docs = rows.groupBy(epoch, batch, document).agg(F.avg(loss).alias("x"))
    return docs.groupBy(epoch, batch).agg(F.avg("x").alias("x")).groupBy(epoch).agg(F.avg("x").alias("loss"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows of epoch metrics to a JSON-lines folder."""
    metrics.write.mode("append").json(path)


def best_epoch(spark: SparkSession, path: str, by: str = "f1") -> DataFrame:
    """The epoch with the best score, the earliest of equals."""
    return spark.read.schema(METRIC).json(path).orderBy(F.desc(by), "epoch").limit(1)


def outcome_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: processed, failed, and all."""
    return rows.agg(F.count_if(F.col(status) == "processed").alias("processed"), F.count_if(F.col(status) == "failed").alias("failed"), F.count("*").alias("total"))


def citation_counts(answers: DataFrame, display: int = 5, citations: str = "citations") -> DataFrame:
    """question_id and how many citations it has: in all, displayed, for reference."""
    n = F.size(citations)
    return answers.select("question_id", n.alias("total"), F.least(n, F.lit(display)).alias("displayed"), F.greatest(n - display, F.lit(0)).alias("referenced"))
