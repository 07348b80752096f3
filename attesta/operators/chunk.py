"""Chunkers: text to ordered chunks. Native ones are expressions; the markdown chunker is a table function per document.

A document's structure is ordered text, so the markdown folds run inside one document and never across rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import fixed_windows, sentences, strip, word_windows

#: What header, fence, separator and caption lines look like.
_HEADER = re.compile(r"^(#{1,6})[ \t]+(.*)$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_CAPTION = re.compile(r"^ *Table\s+\d+[:.]")


def numbered(chunks: DataFrame, *, key: str = "document_id", order: str = "start") -> DataFrame:
    """0-based chunk_number within a document, and a stable id from document and number."""
    out = chunks.withColumn("chunk_number", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)
    return out.withColumn("id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_number").cast("string")), 256))


def chunk_fixed(docs: DataFrame, size: int = 512, overlap: int = 50, *, ident: str = "id", text: str = "text") -> DataFrame:
    """document_id, chunk_number, start, text."""
    parts = docs.where(F.length(text) > 0).select(F.col(ident).alias("document_id"), F.posexplode(fixed_windows(F.col(text), size, overlap)).alias("chunk_number", "x"))
    return parts.select("document_id", "chunk_number", "x.start", "x.text")


def chunk_sentences(docs: DataFrame, *, ident: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(ident).alias("document_id"), F.posexplode(sentences(F.col(text))).alias("chunk_number", "text"))


def chunk_words(docs: DataFrame, size: int = 100, overlap: int = 0, *, ident: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(ident).alias("document_id"), F.posexplode(word_windows(F.col(text), size, overlap)).alias("chunk_number", "text"))


def recursive_chunks(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Split by the coarsest separator that helps; neighbours are packed up to ``size``; the pieces join to the text."""
    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    head, *rest = separators
    parts = [p + head for p in text.split(head)]
    parts[-1] = parts[-1][: -len(head)]
    out, now = [], ""
    for p in parts:
        if len(now) + len(p) <= size:
            now += p
            continue
        out += [now] if now else []
        now = ""
        if len(p) <= size:
            now = p
        else:
            out += recursive_chunks(p, size, tuple(rest))
    return out + ([now] if now else [])


@dataclass
class Markdown:
    """Options of the markdown chunker.

    ``strict`` keeps the compatible rule by which text under a header outside ``levels`` belongs to no chunk; without it
    such text stays with the chunk above.
    """

    levels: tuple[int, ...] = (1, 2, 3, 4)
    preamble: bool = True
    smallest: int = 0
    largest: int = 0
    strict: bool = False

    def chunks(self, text: str) -> list[tuple[int, int, str, str, list[str]]]:
        """(start, end, raw, enhanced, heading path); enhanced has the ancestors' header lines in front."""
        heads, at = [], 0
        for line in text.splitlines(keepends=True):
            if m := _HEADER.match(line.rstrip("\r\n")):
                heads.append((at, len(m[1]), line.rstrip("\r\n")))
            at += len(line)
        cuts = heads if self.strict else [h for h in heads if h[1] in self.levels]
        if not cuts:
            return [(0, len(text), text, text, [])] if text.strip() else []
        out = []
        if self.preamble and text[: cuts[0][0]].strip():
            out.append((0, cuts[0][0], text[: cuts[0][0]], text[: cuts[0][0]], []))
        stack: list[tuple[int, str]] = []
        for i, (start, level, line) in enumerate(cuts):
            end = cuts[i + 1][0] if i + 1 < len(cuts) else len(text)
            stack = [s for s in stack if s[0] < level]
            if level in self.levels:
                raw = text[start:end]
                above = [s[1] for s in stack]
                out.append((start, end, raw, "\n".join([*above, "", raw]) if above else raw, above))
            stack.append((level, line))
        return self._sized(text, out)

    def _sized(self, text: str, chunks: list) -> list:
        if self.smallest:
            merged: list = []
            for c in chunks:
                if merged and len(merged[-1][2].strip()) < self.smallest:
                    merged[-1] = self._joined(merged[-1], c)
                else:
                    merged.append(c)
            if len(merged) > 1 and len(merged[-1][2].strip()) < self.smallest:
                last = merged.pop()
                merged[-1] = self._joined(merged[-1], last)
            chunks = merged
        if not self.largest:
            return chunks
        out = []
        for start, end, raw, enhanced, above in chunks:
            if len(raw) <= self.largest:
                out.append((start, end, raw, enhanced, above))
                continue
            first = raw.split("\n", 1)[0]
            path = [*above, first] if _HEADER.match(first) else above
            for i, (a, b) in enumerate(self._pack(raw)):
                piece = raw[a:b]
                front = above if i == 0 else path
                out.append((start + a, start + b, piece, "\n".join([*front, "", piece]) if front else piece, front))
        return out

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        return (a[0], b[1], a[2] + b[2], a[3] + b[2], a[4])

    def _pack(self, raw: str) -> list[tuple[int, int]]:
        """Paragraphs packed up to the largest size; breaks inside protected regions do not count."""
        safe = [(a, b) for a, b in protected_regions(raw)]
        points = [m.end() for m in re.finditer(r"\n\n+", raw) if not any(a < m.end() < b for a, b in safe)]
        out, start, last = [], 0, 0
        for p in [*points, len(raw)]:
            if p - start > self.largest and last > start:
                out.append((start, last))
                start = last
            last = p
        return [*out, (start, len(raw))]


def protected_regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of fenced code and of pipe tables with a separator row, with their captions.

    Only blank lines may stand between a table and its caption. A caption before a table belongs to it; one behind it
    does too unless another table follows later in the text.
    """
    lines, at, places = text.split("\n"), 0, []
    for line in lines:
        places.append((at, at + len(line)))
        at += len(line) + 1
    out, tables, i, n = [], [], 0, len(lines)
    while i < n:
        if m := _FENCE.match(lines[i]):
            j = next((k for k in range(i + 1, n) if lines[k].strip().startswith(m[1])), n - 1)
            out.append((places[i][0], places[j][1]))
            i = j + 1
        elif "|" in lines[i] and i + 1 < n and "|" in lines[i + 1] and _SEPARATOR.match(lines[i + 1]):
            j = i
            while j + 1 < n and "|" in lines[j + 1]:
                j += 1
            tables.append((i, j))
            i = j + 1
        else:
            i += 1

    def beside(line: int, step: int) -> int | None:
        while 0 <= line < n and not lines[line].strip():
            line += step
        return line if 0 <= line < n and _CAPTION.match(lines[line]) else None

    for a, b in tables:
        above, below = beside(a - 1, -1), beside(b + 1, 1)
        last = below if below is not None and not any(first > below for first, _ in tables) else b
        out.append((places[a if above is None else above][0], places[last][1]))
    return sorted(out)


def chunk_markdown(docs: DataFrame, options: Markdown | None = None, *, ident: str = "id", text: str = "text") -> DataFrame:
    """document_id, chunk_number, start, end, text, enhanced_text, heading_path."""
    options = options or Markdown()
    kind = docs.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, *c) for d, t in zip(f["document_id"], f["text"], strict=True) for i, c in enumerate(options.chunks(t or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_number", "start", "end", "text", "enhanced_text", "heading_path"])

    return docs.select(F.col(ident).alias("document_id"), F.col(text).alias("text")).mapInPandas(run, f"document_id {kind}, chunk_number int, start int, end int, text string, enhanced_text string, heading_path array<string>")


def header_blocks(docs: DataFrame, *, ident: str = "id", text: str = "text") -> DataFrame:
    """Native: (document_id, line, level, title, next_line): each markdown header and where the next one starts."""
    lines = docs.select(F.col(ident).alias("document_id"), F.posexplode(F.split(text, "\n")).alias("line", "x"))
    heads = lines.where(F.col("x").rlike("^#{1,6}[ \t]+")).select("document_id", "line", F.length(F.regexp_extract("x", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("x", "^#+", "")).alias("title"))
    return heads.withColumn("next_line", F.lead("line").over(W.partitionBy("document_id").orderBy("line")))


def heading_paths(docs: DataFrame, *, ident: str = "id", text: str = "text") -> DataFrame:
    """Native as-of join: each header with its ancestors, deeper levels reset by every header above them."""
    heads = header_blocks(docs, ident=ident, text=text)
    before = W.partitionBy("document_id").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    out = heads
    for level in range(1, 6):
        out = out.withColumn(f"__l{level}", F.last(F.when(F.col("level") == level, F.struct("line", "title")), True).over(before))
        out = out.withColumn(f"__r{level}", F.max(F.when(F.col("level") < level, F.col("line"))).over(before))
    parts = [F.when((F.col("level") > n) & (F.coalesce(F.col(f"__r{n}"), F.lit(-1)) < F.col(f"__l{n}.line")), F.col(f"__l{n}.title")) for n in range(1, 6)]
    return out.select("document_id", "line", "level", "title", F.array_join(F.array_compact(F.array(*parts)), " > ").alias("path"))


#: Options of the usual chunkers, by what they are for.
PRESETS: dict[str, dict] = {
    "embeddings": {"strategy": "recursive", "size": 512, "overlap": 50},
    "qa": {"strategy": "sentence", "size": 3, "overlap": 1},
    "semantic": {"strategy": "recursive", "size": 512, "overlap": 50},
    "markdown": {"strategy": "markdown", "levels": (1, 2, 3, 4), "preamble": True},
}


@dataclass
class ChunkConfig:
    """Options of :func:`chunk`; from a document's metadata by :meth:`of`, with a default for each that is missing."""

    strategy: str = "recursive"
    recipe: str = "default"
    lang: str = "en"
    size: int = 512
    overlap: int = 50
    merge_threshold: float = 0.7
    split_threshold: float = 0.3
    headings: bool = True
    described: bool = True

    def __post_init__(self) -> None:
        if self.strategy not in ("recursive", "token", "sentence", "word", "fixed", "markdown", "semantic"):
            raise ValueError(f"unknown chunk strategy {self.strategy!r}")

    @classmethod
    def of(cls, metadata: dict | None, content_type: str) -> ChunkConfig:
        """Markdown for all but plain text, whose headings are not looked for; a value of the wrong type is an error."""
        m = metadata or {}
        recipe = str(m.get("chunker_recipe", "default" if content_type == "txt" else "markdown"))
        return cls(str(m.get("chunker_type", "recursive")).lower(), recipe, str(m.get("lang", "en")), int(m.get("chunk_size", 512)), int(m.get("chunk_overlap", 50)), float(m.get("merge_threshold", 0.7)), float(m.get("split_threshold", 0.3)), recipe == "markdown", bool(m.get("include_metadata", True)))


def config_columns(metadata: Column, kind: Column) -> Column:
    """The same for each row of a table: a struct of options from a metadata map; what does not parse is the default."""
    get = lambda k, cast, default: F.coalesce(F.try_element_at(metadata, F.lit(k)).try_cast(cast), F.lit(default).cast(cast))
    recipe = F.coalesce(F.try_element_at(metadata, F.lit("chunker_recipe")), F.when(kind == "txt", "default").otherwise("markdown"))
    return F.struct(F.lower(get("chunker_type", "string", "recursive")).alias("strategy"), recipe.alias("recipe"), get("lang", "string", "en").alias("lang"), get("chunk_size", "int", 512).alias("size"), get("chunk_overlap", "int", 50).alias("overlap"), get("merge_threshold", "double", 0.7).alias("merge_threshold"), get("split_threshold", "double", 0.3).alias("split_threshold"), (recipe == "markdown").alias("headings"), get("include_metadata", "boolean", True).alias("described"))


def windows_of(parts: Column, size: int, overlap: int, glue: str) -> Column:
    """Runs of ``size`` parts, each sharing ``overlap`` with the one before, joined by ``glue``; none for no parts."""
    step = max(1, size - overlap)
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.greatest(F.size(parts) - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, F.lit(size)), glue))


def chunk(docs: DataFrame, config: ChunkConfig | None = None, *, ident: str = "id", text: str = "text") -> DataFrame:
    """document_id, chunk_number, text by any of the strategies; a text that is not blank has one chunk at least."""
    config = config or ChunkConfig()
    body = F.col(text)
    if config.strategy == "markdown":
        out = chunk_markdown(docs, ident=ident, text=text).select("document_id", "chunk_number", "text")
        return out.where(strip(F.col("text")) != "")
    if config.strategy in ("recursive", "semantic"):

        @F.pandas_udf("array<string>")
        def pieces(t: pd.Series) -> pd.Series:
            return pd.Series([recursive_chunks(x or "", config.size) for x in t], dtype="object")

        parts = pieces(body)
    elif config.strategy == "token":
        parts = windows_of(F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), 0), config.size, config.overlap, " ")
    elif config.strategy == "sentence":
        parts = windows_of(sentences(body), config.size, config.overlap, " ")
    elif config.strategy == "word":
        parts = windows_of(F.filter(F.split(body, r"\s+"), lambda w: w != ""), config.size, config.overlap, " ")
    else:
        parts = F.transform(fixed_windows(body, config.size, config.overlap), lambda w: w["text"])
    kept = F.filter(parts, lambda p: strip(p) != "")
    whole = F.when(F.size(kept) > 0, kept).otherwise(F.array(body))
    return docs.where(strip(F.coalesce(body, F.lit(""))) != "").select(F.col(ident).alias("document_id"), F.posexplode(whole).alias("chunk_number", "text"))


def with_heading_paths(docs: DataFrame, chunks: DataFrame, *, ident: str = "id", text: str = "text") -> DataFrame:
    """``chunks`` (document_id, start, text) of any chunker with the headings above each, outermost first.

    A heading that the chunk itself begins with, and its level and deeper ones, are left out.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["document_id"], f["text"], strict=True):
                at = 0
                for line in (t or "").splitlines(keepends=True):
                    if m := _HEADER.match(line.rstrip("\r\n")):
                        rows.append((d, at, len(m[1]), line.rstrip("\r\n")))
                    at += len(line)
            yield pd.DataFrame(rows, columns=["document_id", "start", "level", "heading"])

    heads = docs.select(F.col(ident).alias("document_id"), F.col(text).alias("text")).mapInPandas(run, f"document_id {kind}, start int, level int, heading string")
    events = heads.unionByName(chunks.select("document_id", "start"), allowMissingColumns=True).distinct()
    before = W.partitionBy("document_id").orderBy("start", F.col("level").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = events.withColumn("seen", F.collect_list(F.when(F.col("level").isNotNull(), F.struct("start", "level", "heading"))).over(before)).where("level IS NULL")

    def step(stack: Column, h: Column) -> Column:
        return F.array_append(F.filter(stack, lambda x: x["level"] < h["level"]), h)

    empty = F.array().cast("array<struct<start:int,level:int,heading:string>>")
    path = F.filter(F.aggregate("seen", empty, step), lambda h: h["start"] != F.col("start"))
    return chunks.join(held.select("document_id", "start", F.transform(path, lambda h: h["heading"]).alias("heading_path")), ["document_id", "start"])
