"""Intents: a detector gives JSON, thresholds and a route table turn it into a decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import strip

DECISION = "intent string, route string, answer string, confidence double, reason string"


def decide(raw: Column, routes: dict[str, str], least: float = 0.5, fallback: str = "rag", answers: dict[str, str] | None = None) -> Column:
    """(intent, route): the intent's route if it is known and confident enough, else the fallback; bad JSON likewise.

    With ``answers``, also the text that ends a question of that intent: the table's, or the detector's own.
    """
    d = F.from_json(raw, DECISION)
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    sure = F.coalesce(d["confidence"], F.lit(0.0)) >= least
    said = []
    if answers is not None:
        texts = F.create_map(*[F.lit(x) for pair in answers.items() for x in pair]) if answers else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        said = [F.coalesce(F.try_element_at(texts, d["intent"]), d["answer"]).alias("answer")]
    return F.struct(F.coalesce(d["intent"], F.lit("unknown")).alias("intent"), F.coalesce(F.when(sure, F.try_element_at(table, d["intent"])), F.lit(fallback)).alias("route"), *said)


def lexical_detector(question: Column) -> Column:
    """A deterministic stand-in for a model: JSON with an intent by the question's words."""
    words = F.size(F.split(strip(question), r"\s+"))
    greeting = F.lower(question).rlike(r"^\s*(hi|hello|thanks|bye)\b")
    intent = F.when(greeting, "smalltalk").when(question.contains("?") | (words >= 5), "question").otherwise("unclear")
    sure = F.when(greeting, 0.9).when(words >= 5, 0.8).otherwise(0.3)
    return F.to_json(F.struct(intent.alias("intent"), sure.alias("confidence")))
