"""Readers: text and markdown files, HTML pages, JSON and JSON lines, side-car metadata, context coercion."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import content_type, html_to_text
from attesta.schema import CONTEXT
from attesta.session import ship

#: File suffixes that a folder scan takes; those whose bytes are not text need a converter.
SUFFIXES = ("pdf", "docx", "html", "htm", "txt", "md")
BINARY = ("pdf", "docx")


def read_folder(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES, convert: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """source, title (file stem), content_type, raw_content of each file; unreadable files are skipped.

    ``convert(bytes, kind)`` turns PDF and DOCX files into text; without it, and where it fails, these are skipped.
    """
    taken = suffixes if convert else tuple(x for x in suffixes if x not in BINARY)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.{" + ",".join(taken) + "}").load(path)
    body = F.decode("content", "UTF-8")
    kind = content_type(F.col("path"))
    text = F.when(kind.isin("html", "web_page"), html_to_text(body)).otherwise(body)
    if convert:

        @F.pandas_udf("string")
        def converted(data: pd.Series, kinds: pd.Series) -> pd.Series:
            def one(b: bytes, k: str) -> str | None:
                try:
                    return convert(b, k) if k in BINARY else None
                except Exception:  # noqa: BLE001  the converter is the caller's
                    return None

            return pd.Series([one(b, k) for b, k in zip(data, kinds, strict=True)], dtype="object")

        text = F.when(kind.isin(*BINARY), converted(F.col("content"), kind)).otherwise(text)
    out = raw.select(F.col("path").alias("source"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("title"), kind.alias("content_type"), text.alias("raw_content"))
    return out.where("raw_content IS NOT NULL")


def from_sources(rows: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """Schema rows from URLs or paths and their content: id from the source, type by its ending, title its last part."""
    where = F.col(source)
    return rows.select(F.sha2(where, 256).alias("id"), F.col(content).alias("content"), F.regexp_extract(where, r"([^/]+)/?$", 1).alias("title"), where.alias("source"), content_type(where).alias("content_type"))


def pages_as_chunks(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Pre-fetched pages as numbered chunks of their text."""
    from attesta.operators.chunk import chunk_fixed, numbered

    return numbered(chunk_fixed(pages_as_documents(pages), size, overlap, text="raw_content").drop("chunk_number"))


def saved_schemas(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Saved schema files (one JSON object each) by a glob, timestamps restored; files that are not JSON are skipped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(glob)


def with_status(new: DataFrame, status: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows of ``new`` that a status table (key, status) does not call processed."""
    return new if status is None else not_yet(new, status.where("status = 'processed'"), key)


def append_status(done: DataFrame, path: str, status: str = "processed", key: str = "id") -> None:
    """Add rows (key, status) to a folder of JSON lines."""
    done.select(key, F.lit(status).alias("status")).write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines (malformed lines dropped), or with ``multi_line`` JSON objects and arrays."""
    reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """Pre-fetched pages (page_id, url, html) as documents; the engine itself does not fetch."""
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("source"), content_type(F.col("url")).alias("content_type"), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), html_to_text(F.col("html")).alias("raw_content"))


def with_sidecar(documents: DataFrame, sidecar: DataFrame, key: str = "stem") -> DataFrame:
    """Documents with the metadata JSON of the same stem, ``{}`` where there is none."""
    side = sidecar.select(key, F.col("metadata").alias("__m")).dropDuplicates([key])
    return documents.join(side, key, "left").withColumn("metadata", F.coalesce("__m", F.lit("{}"))).drop("__m")


def not_yet(new: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key ``done`` does not have."""
    return new.join(done.select(key).distinct(), key, "left_anti")


def coerce_context(item: Any) -> dict[str, Any]:
    """One context item: a mapping with ``content`` or ``text``, or an object with ``text``."""
    if isinstance(item, Mapping):
        body = item.get("content") or item.get("text")
        if not body:
            raise ValueError("a context item needs content or text")
        return {"content": body, "text": body, "title": item.get("title"), "source": item.get("source"), "metadata": {str(k): str(v) for k, v in (item.get("metadata") or {}).items()}}
    if isinstance(getattr(item, "text", None), str):
        return {"content": item.text, "text": item.text, "title": getattr(item, "title", None), "source": getattr(item, "source", None), "metadata": {}}
    raise TypeError(f"not a context item: {type(item).__name__}")


def flatten_context(obj: Any) -> list[dict[str, Any]]:
    """Strings, mappings and nested lists or tuples of them, as context items."""
    if isinstance(obj, str):
        return [coerce_context({"content": obj})]
    if isinstance(obj, list | tuple):
        return [x for o in obj for x in flatten_context(o)]
    return [coerce_context(obj)]


def context_frame(spark: SparkSession, context: Any) -> DataFrame:
    """Context items as rows with ids ``ctx_0`` … and score 1."""
    items = flatten_context(context)
    rows = [(f"ctx_{i}", *(x[c] for c in ("content", "text", "title", "source", "metadata"))) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, f"id string, {CONTEXT}").withColumn("score", F.lit(1.0))


def labelled_sentences(samples: DataFrame) -> DataFrame:
    """Nested samples (id, question, documents array<array<struct<key, text>>>, relevant_keys) as one row a sentence.

    A sample with a null question or documents is dropped; ``relevant`` tells whether its key is listed.
    """
    rows = samples.where("question IS NOT NULL AND documents IS NOT NULL")
    rows = rows.select("id", "question", "relevant_keys", F.posexplode("documents").alias("doc_index", "sentences"))
    rows = rows.select("id", "question", "doc_index", "relevant_keys", F.posexplode("sentences").alias("sentence_index", "s"))
    return rows.select("id", "question", "doc_index", "sentence_index", "s.key", "s.text", F.coalesce(F.array_contains("relevant_keys", F.col("s.key")), F.lit(False)).alias("relevant"))


#: Tables whose rows cost much to work on.
WIDE = ("documents", "pages", "conversations", "embeddings")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``. A wide one of a single file is dealt to all cores; larger ones are read as they are.

    Row groups are not split, so a single file would keep one task busy. Tables of several files are never moved.
    """
    ship(spark)
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.repartition(spark.sparkContext.defaultParallelism) if name in WIDE and len(table.inputFiles()) == 1 else table
