"""Benchmark decontamination: a size-partitioned MinHash containment search, verified by exact shingle containment.

Items are cut into shingles of five words and put into size classes of ratio ``2 ** (1 / 4)``. Each has ``HASHES``
MinHash values, one row each. A long document would drown a short item's MinHash, so its signature is taken over
windows that fit the item's class: an item of a class with upper bound L lies within the window of L - 1 shingles on
either side of any of its shingles. A window can only share the MinHash value of function i if it holds the item's
shingle of least hash under i. So the document's shingles are first joined with these few shingles, and MinHash values
are computed for windows around the hits alone; all other windows cannot collide. One equal value (bands of one row)
makes a candidate. An item of whose shingles 0.8 stand anywhere in a document is missed with a probability below 1e-7.

Candidates are verified over the whole document: distinct shingles of the item that the document holds, as strings.

The signature table is broadcast. Its rows are counted first; beyond ``PASS_ROWS`` the items are dealt to several
passes over the documents, each with a table within the bound.

Defined results: words are runs of letters and digits, lower-cased; a text or item of fewer than five words has no
shingles and is neither found nor searched; null texts likewise; a null item_id is reported as such; rows that repeat
id and text give one row for each item; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, checked_broadcast, let

#: Words of a shingle; least share of an item's shingles; MinHash functions; rows of a broadcast signature table.
WORDS, THRESHOLD, HASHES, PASS_ROWS = 5, 0.8, 64, 400_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def shingles(text: Column, make) -> Column:
    """An array of ``make(word columns)`` over all runs of ``WORDS`` words of ``text``; empty if there are fewer."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) >= WORDS, F.sequence(F.lit(WORDS - 1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: make(*[F.get(w, i - (WORDS - 1 - j)) for j in range(WORDS)]))

    return let(words(text), cut)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, shingles (distinct strings), hashes (of all positions), class bound."""
    text = F.col(text_col)
    cut = items.select(F.col(id_col).alias("item_id"), F.array_distinct(shingles(text, _joined)).alias("shingles"), shingles(text, F.xxhash64).alias("hashes")).where(F.size("hashes") > 0)
    bound = F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes")) * 4) / 4)).cast("int")
    return cut.select("item_id", "shingles", F.array_distinct("hashes").alias("hashes"), bound.alias("bound"))


def signatures(items: DataFrame) -> DataFrame:
    """(s, item_id, bound, fn, least): for each item and function the shingle of least hash and that hash."""
    pair = items.select("item_id", "bound", F.explode("hashes").alias("s")).select("*", F.explode(F.sequence(F.lit(1), F.lit(HASHES))).alias("fn"))
    pair = pair.select("item_id", "bound", "fn", F.struct(F.xxhash64("s", "fn").alias("least"), "s").alias("x"))
    return pair.groupBy("item_id", "bound", "fn").agg(F.min("x").alias("x")).select("x.s", "item_id", "bound", "fn", "x.least")


def _of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, th, ...) that ``keys`` (__d, __t) names."""
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["__d"]) & (docs["th"] == keys["__t"]), "left_semi")


def candidates(keyed: DataFrame, signature: DataFrame, scratch: Scratch) -> DataFrame:
    """(__d, __t, item_id) of documents with a window that shares a MinHash value. ``keyed`` has doc_id, th and text.

    Hits are found with their positions alone; only their documents are read again for the windows.
    """
    hashes = shingles(F.col("text"), F.xxhash64)
    sought = F.broadcast(signature.select("s", "bound").distinct())
    hits = keyed.select("doc_id", "th", F.posexplode_outer(hashes).alias("pos", "s")).join(sought, "s")
    hits = scratch.keep(hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "s", "bound")).alias("hits")).withColumnsRenamed({"doc_id": "__d", "th": "__t"}))
    docs = _of(keyed, checked_broadcast(hits.select("__d", "__t"))).select("doc_id", "th", hashes.alias("hashes"))

    # One hit a row, and only then its window: a document's windows are never held together.
    both = docs.join(hits, docs["doc_id"].eqNullSafe(hits["__d"]) & (docs["th"] == hits["__t"]))
    first = F.greatest(F.col("h.pos") - F.col("h.bound") + 1, F.lit(0))
    near = both.select("__d", "__t", "hashes", F.explode_outer("hits").alias("h"))
    near = near.select("__d", "__t", "h.s", "h.bound", F.slice("hashes", first + 1, F.col("h.pos") + F.col("h.bound") - first).alias("window"))
    least = F.array_min(F.transform("window", lambda x: F.xxhash64(x, F.col("fn"))))
    return near.join(F.broadcast(signature), ["s", "bound"]).where(least == F.col("least")).select("__d", "__t", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, pass_rows: int = PASS_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, item_id, n_shingles, n_shared, containment) of items with at least ``threshold`` in a document.

    ``th`` is the XXH64 of the document's text.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("th"), "text")
    known = scratch.keep(_items(items, item_id, item_text))
    signature = scratch.keep(signatures(known))
    passes = max(1, -(-signature.count() // pass_rows))
    found = [scratch.keep(candidates(keyed, signature.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p), scratch)) for p in range(passes)]
    pairs = reduce(DataFrame.unionByName, found)

    keys = checked_broadcast(scratch.keep(pairs.select("__d", "__t").distinct()))
    again = _of(keyed, keys).select("doc_id", "th", F.explode_outer(shingles(F.col("text"), _joined)).alias("shingle"))
    wanted = checked_broadcast(known.select("item_id", F.size("shingles").cast("bigint").alias("n_shingles"), F.explode("shingles").alias("shingle")))
    shared = again.join(wanted, "shingle").groupBy("doc_id", "th", "item_id", "n_shingles").agg(F.countDistinct("shingle").alias("n_shared"))
    shared = shared.where(F.col("n_shared") >= threshold * F.col("n_shingles"))
    near = shared["doc_id"].eqNullSafe(pairs["__d"]) & (shared["th"] == pairs["__t"]) & shared["item_id"].eqNullSafe(pairs["item_id"])
    return shared.join(pairs, near, "left_semi").select("doc_id", "th", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    scratch = Scratch(docs.sparkSession)
    found = contained_items(docs, items, id_col=id_col, text_col=text_col, threshold=threshold, scratch=scratch)
    found = scratch.keep(found.select(F.col("doc_id").alias("__gone"), F.col("th").alias("__gone_th")).distinct())
    scratch.only(found)
    found = checked_broadcast(found)
    same = docs[id_col].eqNullSafe(found["__gone"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["__gone_th"])
    return docs.join(found, same, "left_anti")
