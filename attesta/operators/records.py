"""Shapes of documents and chunks: from a schema row to a document, with or without chunks, and to JSON and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.functions.text import title_case
from attesta.operators.chunk import Markdown, chunk_markdown, numbered
from attesta.operators.metadata import footer, merge
from attesta.schema import CHUNK_TYPES

#: Metadata that the older chunk footer leaves out.
FOOTER_HIDDEN = ("chunker_type", "chunker_recipe", "lang", "chunk_size", "chunk_overlap", "preserve_headings", "include_metadata", "user_id", "userId", "dataset_id")

_CORE = ("id", "title", "source", "content", "metadata")


def as_text(df: DataFrame, name: str) -> Column:
    """A column as metadata text: timestamps in ISO form, nested values as JSON, others as they print."""
    kind = df.schema[name].dataType.typeName()
    value = F.col(f"`{name}`")
    if kind.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return F.to_json(value) if kind in ("array", "map", "struct") else value.cast("string")


def json_safe(df: DataFrame) -> Column:
    """A row as JSON text that any reader takes: timestamps in ISO form, binary as base64, nulls kept."""
    safe = [F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd'T'HH:mm:ss").alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.base64(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})


def from_schema(rows: DataFrame, content_type: str = "markdown") -> DataFrame:
    """Schema rows (id, content, title, source, metadata, other columns) as documents; custom metadata win over columns."""
    rest = [c for c in rows.columns if c not in _CORE]
    base = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), as_text(rows, c))]), lambda _, v: v.isNotNull()) if rest else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.col("metadata") if "metadata" in rows.columns else base
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c)
    return rows.select("id", text("title"), text("source"), F.lit(content_type).alias("content_type"), F.col("content").alias("raw_content"), merge(base, own).alias("metadata"))


def pre_chunked(documents: DataFrame, options: Markdown | None = None) -> DataFrame:
    """Chunks of :func:`from_schema`'s documents by their headings: raw text, and enhanced text with the metadata footer."""
    parts = chunk_markdown(documents, options, ident="id", text="raw_content").drop("chunk_number")
    parts = numbered(parts).withColumn("chunk_type", F.lit("paragraph"))
    described = parts.join(documents.select(F.col("id").alias("document_id"), "title", "source", "metadata"), "document_id")
    known = lambda c: F.when(F.length(c) > 0, F.col(c)).otherwise("Unknown")
    return described.withColumn("enhanced_text", footer(F.col("enhanced_text"), known("title"), known("source"), F.col("metadata"), with_title=False)).drop("title", "source")


def enhanced(text: Column, heading_path: Column, title: Column, source: Column, metadata: Column, *, headings: bool = True, described: bool = True) -> Column:
    """The older enhancement: the headings above a chunk, the chunk, and a footer with its own list of hidden keys."""
    parts = F.when((F.size(heading_path) > 0) & F.lit(headings), F.concat(heading_path, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(parts, F.array(text))
    if described:
        shown = F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, _: ~k.isin(*FOOTER_HIDDEN))))
        name = lambda c, other: F.when(F.length(c) > 0, c).otherwise(other)
        head = F.array(F.lit(""), F.lit("---"), F.concat(F.lit("Document: "), name(title, "Unknown Document")), F.concat(F.lit("Source: "), name(source, "Unknown Source")))
        parts = F.concat(parts, head, F.transform(shown, lambda e: F.concat(title_case(e["key"]), F.lit(": "), e["value"])))
    return F.array_join(parts, "\n")


def attach_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunks, in order, as one array column; chunks belong by ``document_id``."""
    row = F.struct("chunk_number", *[c for c in chunks.columns if c not in ("chunk_number", "document_id")])
    held = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["chunk_number"] < b["chunk_number"], -1).when(a["chunk_number"] > b["chunk_number"], 1).otherwise(0)).alias("chunks"))
    out = documents.join(held, documents["id"] == held["document_id"], "left").drop("document_id")
    return out.withColumn("chunks", F.coalesce("chunks", F.array().cast(held.schema["chunks"].dataType)))


def chunks_by_type(documents: DataFrame, kind: str) -> DataFrame:
    """(id, chunk) of the chunks of one type in documents with an array ``chunks``."""
    if kind not in CHUNK_TYPES:
        raise ValueError(f"unknown chunk type {kind!r}")
    return documents.select("id", F.explode(F.filter("chunks", lambda c: c["chunk_type"] == kind)).alias("chunk"))


def chunk_by_id(documents: DataFrame, ident) -> DataFrame:
    """(id, chunk) of the first chunk with an id in each document that has it."""
    found = F.get(F.filter("chunks", lambda c: c["id"] == ident), F.lit(0))
    return documents.select("id", found.alias("chunk")).where("chunk IS NOT NULL")


def to_record(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nested arrays too."""
    return df.select(json_safe(df).alias("record"))


def from_record(records: DataFrame, schema: str | StructType, column: str = "record") -> DataFrame:
    """Rows from JSON text of a known schema; timestamps are read back; text that is not JSON gives a row of nulls."""
    return records.select(F.from_json(column, schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("r")).select("r.*")


def display_content(chunks: DataFrame) -> Column:
    """What a reader is shown: the enhanced text, or the text where there is none."""
    return F.coalesce(F.col("enhanced_text"), F.col("text")) if "enhanced_text" in chunks.columns else F.col("text")


def retrieval_context(page_number: Column, section_title: Column, metadata: Column) -> Column:
    """Page, section and retrieval metadata as one map; the metadata's own values win."""
    pairs = F.map_filter(F.create_map(F.lit("page_number"), page_number.cast("string"), F.lit("section_title"), section_title), lambda _, v: v.isNotNull())
    return merge(pairs, metadata)


def output_fields(df: DataFrame, dynamic: tuple[str, ...] = ("user_id", "document_id", "dataset_id"), with_vectors: bool = False) -> DataFrame:
    """The columns of a search result: the fixed ones, the dynamic ones that are there, and vectors only on demand."""
    fixed = ["id", "text", "enhanced_text", "metadata", *dynamic, *(["dense", "sparse"] if with_vectors else [])]
    return df.select(*[c for c in fixed if c in df.columns])


def citation_groups(citations: DataFrame, facts: DataFrame) -> DataFrame:
    """Citations (question_id, number, doc_index, text) beside the facts (question_id, fact_no, doc_index, text) they mark."""
    return citations.join(facts, ["question_id", "doc_index", "text"], "left")


def template_key(question: Column, spans: Column, citation_count: Column, *settings: Column) -> Column:
    """Twelve hex digits that name a frame's inputs: its question, all its spans, the count and settings."""
    return F.substring(F.md5(F.concat_ws("|", F.substring(question, 1, 100), F.array_join(spans, " | "), F.size(spans).cast("string"), citation_count.cast("string"), *[s.cast("string") for s in settings])), 1, 12)
