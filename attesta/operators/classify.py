"""A trainable sentence extractor: logistic regression over lexical features of (question, sentence)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import tokens


def features(question: Column, sentence: Column) -> Column:
    """Shares of the question's and of the sentence's words that both have, and the sentence's length."""
    q, s = F.array_distinct(tokens(question)), F.array_distinct(tokens(sentence))
    both = F.size(F.array_intersect(q, s)).cast("double")
    return F.array(both / F.greatest(F.size(q), F.lit(1)), both / F.greatest(F.size(s), F.lit(1)), F.log1p(F.size(s).cast("double")))


def fit(rows: DataFrame, *, question: str = "question", sentence: str = "text", label: str = "relevant"):
    """A model from labelled sentences; the fit is distributed."""
    data = rows.select(array_to_vector(features(F.col(question), F.col(sentence))).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=50, regParam=1e-3).fit(data)


def score(model, rows: DataFrame, *, question: str = "question", sentence: str = "text", threshold: float = 0.2) -> DataFrame:
    """``rows`` with p (of relevance) and relevant_predicted (p over the threshold)."""
    out = model.transform(rows.withColumn("features", array_to_vector(features(F.col(question), F.col(sentence)))))
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).withColumn("relevant_predicted", F.col("p") > threshold).drop("features", "rawPrediction", "probability", "prediction")
