"""Quality of predictions: binary precision, recall, F1, accuracy; word-level F1 of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import tokens


def binary_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, f1, accuracy of class 1; 0 where a divisor is 0."""
    y, p = F.col(label), F.col(predicted)

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    counts = df.agg(*[F.sum(c.cast("int")).alias(n) for n, c in (("tp", (y == 1) & (p == 1)), ("fp", (y == 0) & (p == 1)), ("fn", (y == 1) & (p == 0)), ("ok", y == p))], F.count("*").alias("n"))
    counts = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return counts.select(*[F.round(c, 6).alias(n) for n, c in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1), ("accuracy", share(F.col("ok"), F.col("n"))))])


def word_f1(gold: Column, predicted: Column) -> Column:
    """F1 over distinct words of two texts."""
    a, b = F.array_distinct(tokens(gold)), F.array_distinct(tokens(predicted))
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))
