"""Retrieval: dense, sparse and BM25 top-k for many queries at once, an inverted-file index, and rank fusion.

Queries are rows. A query set is small beside the corpus, but it grows too: it is sent to the tasks in blocks of
``BLOCK`` queries, so no broadcast grows with the data and no join makes all pairs. Each task keeps the best k of its
rows for each query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import tokens
from attesta.functions.vectors import hashed_term
from attesta.session import scratch_folder

#: Queries sent to the tasks at once; BM25 parameters; rank constant of the fusion.
BLOCK, K1, B, RRF_K = 4096, 1.2, 0.75, 60


def top(hits: DataFrame, k: int, by: str = "question_id", score: str = "score", ident: str = "id") -> DataFrame:
    """The best ``k`` rows a question, with their 1-based rank; ties go to the smaller id."""
    order = W.partitionBy(by).orderBy(F.desc(score), F.col(ident))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, ident: str, vector: str) -> Iterator[pd.DataFrame]:
    """Query rows in blocks, each fetched by a range of its ids."""
    base = queries.select(F.col(ident).alias("question_id"), F.col(vector).alias("q"))
    n = -(-base.count() // BLOCK)
    for i in range(n):
        part = base if n == 1 else base.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == i)
        yield part.toPandas()


class _Best:
    """The best k of each query over all batches of a task; ties go to the smaller key."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple[float, object]]] = [[] for _ in range(n)]

    def add(self, who: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores``: a row for each query in ``who``, a column for each key."""
        if scores.shape[1] > self.k:
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        else:
            least = np.full(len(scores), -np.inf)
        for q, row, cut in zip(who.tolist(), scores, least.tolist(), strict=True):
            held = self.rows[q]
            if len(held) == self.k:
                cut = max(cut, -held[-1][0])
            at = np.flatnonzero(row >= cut)
            self.rows[q] = sorted([*held, *zip((-row[at]).tolist(), keys[at].tolist(), strict=True)])[: self.k]

    def frame(self, ids: np.ndarray) -> pd.DataFrame:
        flat = [(ids[q], key, -s) for q, rows in enumerate(self.rows) for s, key in rows]
        return pd.DataFrame(flat, columns=["question_id", "id", "score"])


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, *, ident: str = "id", vector: str = "vector", query_id: str = "id", query_vector: str = "vector", where: Column | None = None, digits: int = 6) -> DataFrame:
    """Exact cosine top-k: question_id, id, score (rounded), rank. The filter applies before the top-k.

    Each task keeps the best k of each query over all its rows, so what is shuffled does not grow with the rows.
    """
    base = (corpus if where is None else corpus.where(where)).select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    id_type, q_type = base.schema["id"].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    found = []
    for block in _blocks(queries, query_id, query_vector):
        shared = corpus.sparkSession.sparkContext.broadcast((block["question_id"].to_numpy(), _unit(block["q"])))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            held, everyone = _Best(len(ids), k), np.arange(len(ids))
            for f in frames:
                if len(f):
                    held.add(everyone, np.round(q @ _unit(f["v"]).T, digits), f["id"].to_numpy())
            yield held.frame(ids)

        found.append(base.mapInPandas(best, f"question_id {q_type}, id {id_type}, score double"))
    if not found:
        return base.limit(0).select(F.lit(None).cast(q_type).alias("question_id"), "id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    return top(reduce(DataFrame.unionByName, found), k)


class InvertedFile:
    """Inverted-file index: centroids fitted to a bounded sample, every row assigned; a search probes the nearest lists.

    The rows are written by list (``path``; a scratch folder by default), so a search reads the probed lists alone.
    """

    def __init__(self, corpus: DataFrame, lists: int = 16, *, ident: str = "id", vector: str = "vector", sample: int = 20_000, rounds: int = 10, extra: tuple[str, ...] = (), path: str | None = None):
        rows = corpus.select(ident, vector).orderBy(F.xxhash64(ident), ident).limit(sample).toPandas()
        self.centres, self.spark = fit_centres(_unit(rows[vector]), lists, rounds), corpus.sparkSession
        self.path = path or f"{scratch_folder(self.spark)}/lists"
        listed = corpus.select(F.col(ident).alias("id"), F.col(vector).alias("vector"), *extra).withColumn("list", nearest_list(F.col("vector"), self.centres))
        listed.write.partitionBy("list").parquet(self.path)
        self.schema = listed.schema

    def search(self, queries: DataFrame, k: int, probes: int = 4, *, query_id: str = "id", query_vector: str = "vector", where: Column | None = None, digits: int = 6) -> DataFrame:
        index = self.spark.read.schema(self.schema).parquet(self.path)
        return probe_lists(index if where is None else index.where(where), self.centres, queries, k, probes, query_id=query_id, query_vector=query_vector, digits=digits)


def fit_centres(v: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = v[:: max(1, len(v) // lists)][:lists].copy()
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = v[near == c].mean(0)
        n = np.linalg.norm(centres, axis=1, keepdims=True)
        centres /= np.where(n > 0, n, 1)
    return centres


def nearest_list(vector: Column, centres: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def assign(x: pd.Series) -> pd.Series:
        return pd.Series((_unit(x) @ centres.T).argmax(1) if len(x) else np.zeros(0, np.int32))

    return assign(vector)


def probe_lists(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, *, query_id: str = "id", query_vector: str = "vector", digits: int = 6) -> DataFrame:
    """Cosine top-k over the ``probes`` nearest lists of each query; ``index``: id, vector, list (a partition column)."""
    q_type, id_type, found = queries.schema[query_id].dataType.simpleString(), index.schema["id"].dataType.simpleString(), []
    for block in _blocks(queries, query_id, query_vector):
        q = _unit(block["q"])
        probed = np.zeros((len(q), len(centres)), bool)
        np.put_along_axis(probed, np.argsort(-(q @ centres.T), axis=1)[:, :probes], True, axis=1)
        shared = index.sparkSession.sparkContext.broadcast((block["question_id"].to_numpy(), q, probed))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, probed = shared.value
            held = _Best(len(ids), k)
            for f in frames:
                for at, part in f.groupby("list"):
                    who = np.flatnonzero(probed[:, at])
                    held.add(who, np.round(q[who] @ _unit(part["vector"]).T, digits), part["id"].to_numpy())
            yield held.frame(ids)

        wanted = np.flatnonzero(probed.any(0)).tolist()
        base = index.where(F.col("list").isin(wanted)).select("id", "vector", "list")
        found.append(base.mapInPandas(best, f"question_id {q_type}, id {id_type}, score double"))
    if not found:
        return index.limit(0).select(F.lit(None).cast(q_type).alias("question_id"), "id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    return top(reduce(DataFrame.unionByName, found), k)


def sparse_vectors(corpus: DataFrame, *, ident: str = "id", text: str = "text", size: int = 30522) -> DataFrame:
    """Postings (id, place, weight) of a hashed bag of words: weight is 1 + ln(tf)."""
    words = corpus.select(F.col(ident).alias("id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("id", hashed_term(F.col("term"), size).alias("place")).agg((1 + F.ln(F.count("*"))).alias("weight"))


def sparse_topk(postings: DataFrame, query_postings: DataFrame, k: int, digits: int = 6, where: DataFrame | None = None) -> DataFrame:
    """Inner-product top-k; documents that share no place with a query are absent. Queries: question_id, place, weight.

    ``where``: the ids that may be found; the filter applies before the top-k.
    """
    q = query_postings.withColumnRenamed("weight", "qw")
    near = postings if where is None else postings.join(where.select("id"), "id", "left_semi")
    scored = near.join(q, "place").groupBy("question_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), digits).alias("score"))
    return top(scored, k)


def sparse_text_topk(corpus: DataFrame, query_postings: DataFrame, k: int, *, ident: str = "id", text: str = "text", size: int = 30522, where: Column | None = None, digits: int = 6) -> DataFrame:
    """As :func:`sparse_topk` over texts without stored postings: only places that a query has are counted and shuffled."""
    base = corpus if where is None else corpus.where(where)
    words = base.select(F.col(ident).alias("id"), F.explode(tokens(F.col(text))).alias("term")).select("id", hashed_term(F.col("term"), size).alias("place"))
    near = words.join(query_postings.select("place").distinct(), "place", "left_semi").groupBy("id", "place").agg((1 + F.ln(F.count("*"))).alias("weight"))
    return sparse_topk(near, query_postings, k, digits)


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, *, ident: str = "id", text: str = "text", query_id: str = "id", query_text: str = "text", where: Column | None = None, digits: int = 6) -> DataFrame:
    """BM25 top-k; statistics are over the whole corpus, the filter applies before the top-k.

    Postings are cut to the queries' terms before they are counted, so only these are shuffled.
    """
    keep = F.lit(True) if where is None else where
    docs = corpus.select(F.col(ident).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"), keep.alias("keep"))
    asked = queries.select(F.col(query_id).alias("question_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("w").cast("double")).alias("avgdl"))
    sized = docs.select("id", "keep", F.size("w").cast("double").alias("dl"), F.explode("w").alias("term"))
    tf = sized.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "keep", "dl", "term").agg(F.count("*").cast("double").alias("tf"))
    return bm25_score(tf, stats, asked, k, digits, keep="keep")


def bm25_score(tf: DataFrame, stats: DataFrame, asked: DataFrame, k: int, digits: int = 6, *, keep: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 top-k from postings (id, dl, term, tf) that are cut to the terms of ``asked`` (question_id, term).

    ``stats``: one row (n, avgdl). Document frequencies count all postings; ``keep`` (a column) or ``allowed`` (ids) then
    say which rows may be found.
    """
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    near = tf.where(keep) if keep else tf
    near = near if allowed is None else near.join(allowed, "id", "left_semi")
    scored = near.join(df, "term").join(asked, "term").join(F.broadcast(stats)).groupBy("question_id", "id").agg(F.round(F.sum(weight), digits).alias("score"))
    return top(scored, k)


def sanitise_weights(weights: dict, available: tuple[str, ...] = ("dense", "sparse", "full_text")) -> dict[str, float]:
    """Known methods with a positive number; whatever is not a number goes, text too; none left is an error."""
    out = {m: float(w) for m, w in weights.items() if m in available and isinstance(w, int | float) and w > 0}
    if not out:
        raise ValueError("no usable hybrid weights")
    return out


def normalise_weights(weights: dict[str, float], methods: tuple[str, ...]) -> dict[str, float]:
    """Weights of the available methods, summing to one; equal ones if all are zero."""
    given = {m: max(0.0, float(weights.get(m, 0.0))) for m in methods}
    total = sum(given.values())
    return {m: w / total for m, w in given.items()} if total else {m: 1 / len(methods) for m in methods}


def fuse(ranked: dict[str, DataFrame], weights: dict[str, float], k: int, rrf_k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (question_id, id, rank).

    rrf_score is higher for better; score = 1 - rrf_score is the compatible distance. Ties: method order, rank, id. One
    method alone keeps its own score.
    """
    names = [m for m in ranked if m in weights]
    if len(names) == 1:
        return ranked[names[0]].where(F.col("rank") <= k)
    share = normalise_weights(weights, tuple(names))
    parts = [ranked[m].select("question_id", "id", F.lit(i).alias("m"), "rank", (F.lit(share[m]) / (rrf_k + F.col("rank"))).alias("s")) for i, m in enumerate(names)]
    both = reduce(DataFrame.unionByName, parts).groupBy("question_id", "id").agg(F.round(F.sum("s"), digits).alias("rrf_score"), F.min(F.struct("m", "rank")).alias("first"))
    order = W.partitionBy("question_id").orderBy(F.desc("rrf_score"), "first.m", "first.rank", "id")
    out = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("question_id", "id", "rrf_score", F.round(1 - F.col("rrf_score"), digits).alias("score"), "rank")


def route(text: str | None, dense: bool, sparse: bool, search_type: str = "auto", weights: dict | None = None) -> str:
    """Which search a request means: filter, weighted, hybrid, dense, sparse or full_text; impossible ones are errors."""
    if not text:
        return "filter"
    if weights is not None:
        sanitise_weights(weights)
        return "weighted"
    if search_type == "auto":
        search_type = "hybrid" if dense and sparse else "dense" if dense else "sparse" if sparse else "full_text"
    if search_type not in ("dense", "sparse", "hybrid", "full_text"):
        raise ValueError(f"unknown search type {search_type!r}")
    if (search_type == "hybrid" and not (dense and sparse)) or (search_type == "dense" and not dense) or (search_type == "sparse" and not sparse):
        raise ValueError(f"{search_type} search needs vectors that are missing")
    return search_type


def rerank(hits: DataFrame, scored: Column, k: int = 50, keep_tail: bool = True) -> DataFrame:
    """Order the first ``k`` hits a question by ``scored`` (ties by retrieval rank); the tail follows as it was, or goes."""
    head = F.col("rank") <= k
    base = hits.withColumn("rerank_score", F.when(head, scored))
    order = W.partitionBy("question_id").orderBy(F.col("rank") > k, F.desc("rerank_score"), "rank")
    out = base.withColumn("new_rank", F.row_number().over(order))
    return out if keep_tail else out.where(head)


def best_example(questions: DataFrame, examples: DataFrame, *, ident: str = "id", vector: str = "vector") -> DataFrame:
    """Nearest example (id, template, vector) of each question by cosine; the first of equals.

    Examples are configuration and are sent to the tasks; more than ``BLOCK`` of them are an error.
    """
    rows = examples.select("id", "template", "vector").orderBy("id").limit(BLOCK + 1).toPandas()
    if len(rows) > BLOCK:
        raise ValueError(f"more than {BLOCK} examples")
    q_type, e_type = questions.schema[ident].dataType.simpleString(), examples.schema["id"].dataType.simpleString()
    shared = questions.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), rows["template"].tolist(), _unit(rows["vector"]) if len(rows) else None))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, templates, e = shared.value
        for f in frames:
            if len(f) and e is not None:
                s = np.round(_unit(f["v"]) @ e.T, 6)
                at = s.argmax(1)
                yield pd.DataFrame({"question_id": f["question_id"], "example_id": ids[at], "template": [templates[i] for i in at], "score": s[np.arange(len(at)), at]})

    return questions.select(F.col(ident).alias("question_id"), F.col(vector).alias("v")).mapInPandas(nearest, f"question_id {q_type}, example_id {e_type}, template string, score double")
