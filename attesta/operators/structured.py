"""Structured answers: semantic placeholders, each with its own spans; and the shapes of search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip

_ITEMS = "array<struct<text:string,doc:int>>"


def normalise(raw: Column) -> Column:
    """Model output as map of placeholder to array of (text, doc): plain strings get document 0, other things go.

    Objects keep their text, and their document or 0; items without text go. Output that is not a JSON object is empty.
    """
    parsed = F.from_json(raw, "map<string,array<variant>>")
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(v).startswith("OBJECT"), F.try_variant_get(v, "$.text", "string"))
    doc = lambda v: F.when(kind(v).startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.doc", "int"), F.lit(0))).otherwise(F.lit(0))
    item = lambda v: F.struct(text(v).alias("text"), doc(v).alias("doc"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_ITEMS}>"))
    return F.coalesce(F.transform_values(parsed, lambda _, v: F.filter(F.transform(v, item), lambda x: F.length(x["text"]) > 0)), empty)


def verified(spans: Column, contents: Column) -> Column:
    """Spans whose document index exists and whose text, stripped, stands in that document; repeats within a document go."""
    spans = F.transform(spans, lambda s: F.struct(strip(s["text"]).alias("text"), s["doc"].alias("doc")))
    return F.array_distinct(F.filter(spans, lambda s: (F.length(s["text"]) > 0) & (s["doc"] >= 0) & (s["doc"] < F.size(contents)) & F.coalesce(F.contains(F.get(contents, s["doc"]), s["text"]), F.lit(False))))


def hits_to_results(hits: DataFrame, metadata: str = "metadata", promoted: tuple[str, ...] = ("user_id", "document_id", "dataset_id")) -> DataFrame:
    """Metadata text as a map; text that is not a JSON object becomes ``raw``; promoted columns are merged back in."""
    raw = F.col(metadata)
    parsed = F.from_json(raw, "map<string,string>")
    base = F.when(raw.isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.coalesce(F.when(F.substring(F.ltrim(raw), 1, 1) == "{", parsed), F.create_map(F.lit("raw"), raw)))
    for c in (c for c in promoted if c in hits.columns):
        base = F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, _: k != c)), F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))))  # noqa: B023
    return hits.withColumn(metadata, base)


def flat_highlights(answers: DataFrame, ident: str = "question_id", documents: str = "highlights") -> DataFrame:
    """One row a highlight of all documents: (question, doc_index, text, start, end), by document and start."""
    rows = answers.select(ident, F.posexplode(documents).alias("doc_index", "d")).select(ident, "doc_index", F.explode("d.marks").alias("m"))
    return rows.select(ident, "doc_index", "m.*").orderBy(ident, "doc_index", "start")


def containing(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose text holds ``needle``, whatever the case."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(needle.lower())))


def citation_markers(answer: Column) -> Column:
    """Numbers of the ``[n]`` markers of an answer, outside code."""
    plain = F.regexp_replace(F.regexp_replace(answer, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))


def mean_pool(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key, in the JVM: one partial average a place."""
    places = vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
