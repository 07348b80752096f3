"""Personal data by patterns and by information-theoretic sanitisation.

Patterns find the protected entities (email, ip, card, phone). The corpus then tells which other terms reveal them:
over all texts, n(t) counts a term, n(t, k) its occurrences within ``CONTEXT`` words of an entity of kind k, and
PMI(t, k) = log2(n(t, k) N / (n(t) n(k))) is held against the information IC(k) = -log2(n(k) / N) of the kind itself.
A term that tells at least ``DISCLOSURE`` of it, with enough support, is a span where it stands in such a context; it is
generalised to its kind's name, and removed where it tells all of it.

Support is a fixed number of distinct documents, ``LEAST``, so that a term does not lose its spans as documents are added,
and one document that repeats a word beside an address gives it none. All
counts are over all documents, added up per task before the shuffle, and stay distributed tables. Terms are sent to the
workers only where a count shows that they are few (``FEW_TERMS``); else they are joined to their occurrences.

Defined results: a null text is empty; an empty text has no spans; rows that repeat a doc_id each get a row and count
as often as they stand; other columns are ignored; an empty table gives an empty result and no terms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch
from attesta.llm.spans import digest, ordered, over_texts

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity; share of the kind's information; least documents with it near a kind; terms that may be broadcast.
CONTEXT, DISCLOSURE, LEAST, FEW_TERMS = 5, 0.8, 5, 100_000

# The contracts' patterns. A run of digits is only tried from its start, as a later start in it cannot do better.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done, "email"


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in code points."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def context_words(text: str, found: list[tuple[int, int, str]], context: int = CONTEXT) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, word) of up to ``context`` words before and after each entity, outside all entities."""
    taken = sorted((a, b) for a, b, _ in found)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    free, at = [], 0
    for a, b in words:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and a < y for x, y in taken[at : at + 4]):
            free.append((a, b))
    starts = [a for a, _ in free]
    for a, b, kind in found:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        for x, y in free[max(0, i - context) : i] + free[j : j + context]:
            yield kind, x, y, text[x:y].lower()


def _counts(docs: DataFrame, make, id_col: str, text_col: str) -> DataFrame:
    """(kind, term, n, docs) over all texts: occurrences, and rows that have any; ``make()`` gives a text's (kind, term)s."""

    def run(batches):
        terms, total, texts = make(), Counter(), Counter()

        def flush():
            keys = list(total)
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (total, texts))], ["kind", "term", "n", "docs"])
            total.clear()
            texts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                found = Counter(terms(text.as_py() or ""))
                total.update(found)
                texts.update(found.keys())
                if len(total) > 100_000:
                    yield flush()
        yield flush()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, term string, n bigint, docs bigint").groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scored_terms(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, few: int = FEW_TERMS) -> DataFrame:
    """(kind, term, told): share of the kind's information that the term tells, for the terms at or above the threshold."""

    def contexts():
        return lambda text: ((k, w) for k, _, _, w in context_words(text, entities(text)))

    near = scratch.keep(_counts(docs, contexts, id_col, text_col))
    words = near.groupBy("kind").agg(F.sum("n").alias("words"))
    able = scratch.keep(near.where(F.col("docs") >= LEAST).select("kind", "term", "n"))
    terms = scratch.keep(able.select("term").distinct())
    wanted = frozenset(r.term for r in terms.collect()) if terms.limit(few + 1).count() <= few else None

    def everywhere():
        def found(text: str):
            parts = _WORD.findall(text.lower())
            return [("all", "")] * len(parts) + [("term", w) for w in parts if wanted is None or w in wanted]

        return found

    counted = scratch.keep(_counts(docs, everywhere, id_col, text_col))
    everything = counted.where("kind = 'all'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base = F.greatest(F.col("words") / F.lit(max(everything, 1)), F.lit(1e-12))
    told = F.when(base < 1, F.log2(F.greatest(F.col("n") / F.col("everywhere"), F.lit(1e-12)) / base) / -F.log2(base)).otherwise(0.0)
    scored = able.join(F.broadcast(words), "kind").join(counted.where("kind = 'term'").select("term", F.col("n").alias("everywhere")), "term")
    return scratch.keep(scored.select("kind", "term", told.alias("told")).where(F.col("told") >= disclosure))


def disclosing_terms(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> dict[tuple[str, str], float]:
    """The rows of :func:`scored_terms` on the driver, to look at."""
    scored = scored_terms(docs, Scratch(docs.sparkSession), id_col=id_col, text_col=text_col, disclosure=disclosure)
    return {(r.kind, r.term): r.told for r in scored.collect()}


def _with_terms(docs: DataFrame, row, fields: list, id_col: str, text_col: str, few: int) -> DataFrame:
    """doc_id and the ``fields`` of ``row(text, terms)``, where ``terms`` has all disclosing terms that stand in the text."""
    scratch = Scratch(docs.sparkSession)
    scored = scored_terms(docs, scratch, id_col=id_col, text_col=text_col, few=few)
    if scored.limit(few + 1).count() <= few:
        terms = {(r.kind, r.term): r.told for r in scored.collect()}
        return over_texts(docs, lambda: lambda text: row(text, terms), fields, id_col=id_col, text_col=text_col)
    # Numbered and written, as the numbers of a second run may be others.
    texts = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def places(text: str) -> tuple:
        return ([{"kind": k, "term": w} for k, w in {(k, w) for k, _, _, w in context_words(text, entities(text))}],)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("term", pa.string())]))
    pairs = over_texts(texts, lambda: places, [("p", "array<struct<kind:string,term:string>>", kind)], id_col="row").select(F.col("doc_id").alias("row"), F.inline("p"))
    held = pairs.join(scored, ["kind", "term"]).groupBy("row").agg(F.collect_list(F.struct("kind", "term", "told")).alias("terms"))
    both = texts.join(held, "row", "left").select("doc_id", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                rows = [row(t or "", {(x["kind"], x["term"]): x["told"] for x in found or ()}) for t, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f[2]) for c, f in zip(zip(*rows, strict=True), fields, strict=True))], ["doc_id", *(f[0] for f in fields)])

    return both.mapInArrow(run, ", ".join([f"doc_id {both.schema['doc_id'].dataType.simpleString()}", *(f"{name} {kind}" for name, kind, _ in fields)]))


def find_spans(text: str, terms: dict[tuple[str, str], float]) -> tuple[list, list]:
    """Base spans and the spans that the disclosing terms add."""
    found = entities(text)
    extra = {(a, b, "term") for k, a, b, w in context_words(text, found) if (k, w) in terms} if terms and found else set()
    return found, sorted(extra)


def sanitise_text(text: str, terms: dict[tuple[str, str], float]) -> str:
    """Entities become their kind's name; disclosing terms are generalised, or removed if they tell everything."""
    base, _ = find_spans(text, terms)
    cuts = [(a, b, f"[{k.upper()}]") for a, b, k in base]
    for k, a, b, w in context_words(text, base) if terms else ():
        if (k, w) in terms:
            cuts.append((a, b, "" if terms[k, w] >= 1 else f"[{k.upper()} TERM]"))
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", few: int = FEW_TERMS) -> DataFrame:
    """doc_id and the sanitised text."""
    return _with_terms(docs, lambda text, terms: (sanitise_text(text, terms),), [("text", "string", pa.string())], id_col, text_col, few)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", few: int = FEW_TERMS) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans as text, and how many: of terms, and of all kinds."""

    def row(text: str, terms: dict[tuple[str, str], float]) -> tuple:
        base, extra = find_spans(text, terms)
        n = Counter(k for _, _, k in base)
        return *(n[k] for k in KINDS[:4]), digest(ordered(base, KINDS)), ordered(base + extra, KINDS), len(extra), len(base) + len(extra)

    counts = [(f"n_{k}", "bigint", pa.int64()) for k in KINDS[:4]]
    fields = [*counts, *((c, "string", pa.string()) for c in ("base_sha256", "spans")), *((c, "bigint", pa.int64()) for c in ("n_term", "n_spans"))]
    return _with_terms(docs, row, fields, id_col, text_col, few)
