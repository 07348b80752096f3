"""Metadata: merge with precedence, promotion of keys to columns, footers, flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import title_case

#: Keys that become columns, and keys that footers leave out.
PROMOTED = ("user_id", "document_id", "dataset_id")
HIDDEN = ("user_id", "dataset_id", "userId")


def merge(*maps: Column) -> Column:
    """Later maps win. ``map_concat`` would need a session setting for that, so entries are folded."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def over(low: Column, high: Column) -> Column:
        return F.map_from_entries(F.concat(F.map_entries(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k))), F.map_entries(high)))

    return reduce(over, (F.coalesce(m, empty) for m in maps))


def promote(df: DataFrame, metadata: str = "metadata", keys: tuple[str, ...] = PROMOTED) -> DataFrame:
    """Move ``keys`` of the map to columns of their own; these push down to the files."""
    out = df.withColumns({k: F.try_element_at(F.col(metadata), F.lit(k)) for k in keys})
    return out.withColumn(metadata, F.map_filter(metadata, lambda k, _: ~k.isin(*keys)))


def footer(text: Column, title: Column, source: Column, metadata: Column, with_title: bool = True) -> Column:
    """``# title`` in front (if there is one), then ``---``, Document, Source and the other keys in key order."""
    shown = F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, _: ~k.isin(*HIDDEN))))
    lines = F.transform(shown, lambda e: F.concat(title_case(e["key"]), F.lit(": "), e["value"]))
    front = F.when(F.length(title) > 0, F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise("") if with_title else F.lit("")
    head = F.array_compact(F.array(F.lit(""), F.lit("---"), F.concat(F.lit("Document: "), F.coalesce(title, F.lit(""))), F.when((F.length(source) > 0) | F.lit(not with_title), F.concat(F.lit("Source: "), F.coalesce(source, F.lit(""))))))
    return F.concat(front, text, F.lit("\n"), F.array_join(F.concat(head, lines), "\n"))


def unknown_to_metadata(df: DataFrame, known: tuple[str, ...], metadata: str = "metadata") -> DataFrame:
    """Columns that the schema does not know become entries of the metadata map; given entries win."""
    extra = [c for c in df.columns if c not in known and c != metadata]
    if not extra:
        return df
    more = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda _, v: v.isNotNull())
    return df.withColumn(metadata, merge(more, F.col(metadata)) if metadata in df.columns else more).drop(*extra)


def storage_row(df: DataFrame, created: str = "created_at", content: str = "content") -> DataFrame:
    """A schema row as it is stored: without its content, the time of creation in epoch seconds."""
    out = df.drop(content) if content in df.columns else df
    return out.withColumn(created, F.unix_timestamp(F.col(created).cast("timestamp"))) if created in df.columns else out


def iso_time(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(column: Column) -> Column:
    """ISO text as a timestamp; text that is none is null."""
    return F.try_to_timestamp(column, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))


def chunk_metadata(document: Column, chunk: Column, **base: Column) -> Column:
    """Metadata of a chunk: base fields, then the document's, then the chunk's own; later ones win."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fixed = F.map_filter(F.create_map(*[x for k, v in base.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()) if base else empty
    return merge(fixed, document, chunk)
