"""Quality classifier by co-training.

One view sees a text's content: its words, and the shapes of its tokens with their shares. The other sees the page's
metadata alone: language, source, recorded length. Each view is a naive Bayes model, so that a fit is a sum of counts.
In each round every unlabelled document of the table is scored by both views, and what one view is sure of (calibrated
probability of at least ``CONFIDENT``) is counted for the other, which is thereby fitted again: the exchange grows with
the corpus, in two sums over tables of features. Each view is calibrated on labelled rows kept back for it, and a
logistic regression on the calibrated logits combines them. All documents are then scored.

The fit takes at most ``LABELLED`` labelled documents of least hash, and all unlabelled rows. To the driver come counts
a place of the feature space (``PLACES``), and three numbers for each labelled document kept back.

Defined results: a null text is empty; null metadata are values of their own, and metadata columns that a table does not
have are left out; without labels of both classes every document has the score of the labels' share (1 if there are
none) and is kept unless that is below the cut; rows that repeat a doc_id each get a row; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, fresh_names, lean
from attesta.llm.toxicity import logistic

#: Labelled documents of the fit; rounds; least probability of what is handed over; cut; tokens held by a worker.
LABELLED, ROUNDS, CONFIDENT, CUT, MEMO = 4000, 3, 0.95, 0.5, 400_000
#: Places of the feature space: words, shapes, metadata. Metadata columns, and shares as whole numbers up to this.
PLACES, METADATA, WHOLE = (1 << 14, 1 << 11, 1 << 9), ("lang", "source", "n_chars"), 1000
_SIZE = sum(PLACES)
_FEATURES = "words array<int>, shapes array<int>, shares array<int>, meta array<int>"


def _place(group: int, name: str) -> int:
    return sum(PLACES[:group]) + zlib.crc32(name.encode("utf-8", "surrogatepass")) % PLACES[group]


def shape(token: str) -> str:
    """A token with its letters and digits as classes, and repeats as one: ``THERE!!`` is ``X!``, ``don't`` is ``x'x``."""
    out = ""
    for c in token:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out


class Featurer:
    """Features of texts; places of tokens are kept between them."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _token(self, token: str) -> tuple[int, int]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            word = "".join(c for c in token.lower() if c.isalnum())
            found = self.known[token] = (_place(0, word) if word else -1, _place(1, shape(token)))
        return found

    def text(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Places of the distinct words; places of shapes and their shares, with those of repetition and length."""
        counts = Counter((text or "").split())
        n, words, shapes = counts.total(), set(), Counter()
        for token, k in counts.items():
            word, form = self._token(token)
            words.add(word)
            shapes[form] += k
        words.discard(-1)
        shares = {p: WHOLE * k // n for p, k in shapes.items()}
        distinct = 10 * len(counts) // n if n else 0
        for name in (f"distinct {distinct}", f"words {n.bit_length()}"):
            shares[_place(1, name)] = WHOLE
        return sorted(words), list(shares), list(shares.values())


def metadata_places(row: dict) -> list[int]:
    """A place for each column's value; numbers by their size."""
    out = []
    for name, value in row.items():
        missing = value is None or (isinstance(value, float) and not math.isfinite(value))
        kind = "none" if missing else f"size {int(abs(value)).bit_length()}" if isinstance(value, int | float | np.number) else str(value)
        out.append(_place(2, f"{name} {kind}"))
    return out


class CoTrained:
    """``weights``: log odds of each place; ``scale``: calibration of the two views; ``combine``: of both together."""

    def __init__(self, weights: np.ndarray, scale: list[np.ndarray], combine: np.ndarray, handed: list[tuple[int, int]] | None = None):
        self.weights, self.scale, self.combine, self.handed = weights, scale, combine, handed or []

    def evidence(self, f: Features) -> np.ndarray:
        """A row a document: constant, mean log odds of its words, of its shapes, sum over its metadata."""
        words = f.total(f.words, self.weights) / np.maximum(f.words[1], 1)
        shapes = f.total(f.shapes, self.weights, f.shares) / WHOLE
        return np.c_[np.ones(f.n), words, shapes, f.total(f.meta, self.weights)]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality 1 by the text view, by the metadata view and by both, from rows of ``evidence``."""
        logits = self._logits(x)
        both = np.c_[np.ones(len(x)), logits] @ self.combine
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits.T, both))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x[:, :3] @ self.scale[0], x[:, [0, 3]] @ self.scale[1]]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        one = np.ones(len(y))
        self.scale = [logistic(x[:, :3], y, one, 0.01), logistic(x[:, [0, 3]], y, one, 0.01)]
        self.combine = logistic(np.c_[one, self._logits(x)], y, one, 0.01)


class Features:
    """Lists of places of a batch of documents."""

    def __init__(self, words: pa.Array, shapes: pa.Array, shares: pa.Array, meta: pa.Array):
        self.n = len(words)
        self.words, self.shapes, self.meta = map(self._flat, (words, shapes, meta))
        self.shares = shares.flatten().to_numpy(zero_copy_only=False)

    @staticmethod
    def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(zero_copy_only=False), sizes

    def owners(self, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.repeat(np.arange(self.n), lists[1])

    def total(self, lists: tuple[np.ndarray, np.ndarray], weights: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        w = weights[lists[0]]
        return np.bincount(self.owners(lists), w if times is None else w * times, self.n)

    def count(self, counts: np.ndarray, view: int, label: np.ndarray) -> None:
        """Add the documents of ``label`` 0 or 1 (others are -1) to ``counts`` of a view's places."""
        parts = [(self.words, None), (self.shapes, self.shares)] if view == 0 else [(self.meta, None)]
        for lists, times in parts:
            of = label[self.owners(lists)]
            for k in (0, 1):
                here = of == k
                counts[k] += np.bincount(lists[0][here], None if times is None else times[here], _SIZE).astype(np.int64)


def _weights(counts: np.ndarray) -> np.ndarray:
    """Log odds of each place, smoothed by one document a place (one whole share for shapes)."""
    out, at = np.zeros(_SIZE), 0
    for size, one in zip(PLACES, (1, WHOLE, 1), strict=True):
        part = counts[:, at : at + size] / one + 1.0
        part /= part.sum(1, keepdims=True)
        out[at : at + size] = np.log(part[1]) - np.log(part[0])
        at += size
    return out


def _columns(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]):
    """(doc_id, text, metadata columns) with plain names, and the metadata's names."""
    have = {c for c, _ in docs.dtypes}
    names = [c for c in metadata if c in have]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"meta_{i}") for i, c in enumerate(names))), names


def featured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id and the features of each row."""
    base, names = _columns(docs, id_col, text_col, metadata)
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurer = Featurer()
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                text = list(zip(*map(featurer.text, part.column(1).to_pylist()), strict=True))
                meta = [metadata_places(dict(zip(names, values, strict=True))) for values in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)] if names else [[]] * len(part)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, ints) for c in (*text, meta))], ["doc_id", "words", "shapes", "shares", "meta"])

    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {_FEATURES}")


_PARTS = ("words", "shapes", "shares", "meta")


def _counts(rows: DataFrame, model: CoTrained | None) -> tuple[np.ndarray, list[int]]:
    """Counts (class, place) of the rows by their ``label``; of rows without one, by what the other view is sure of.

    Also how many rows were counted for the text view and for the metadata view.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, handed = np.zeros((2, _SIZE), np.int64), [0, 0]
        for batch in batches:
            f = Features(*(batch.column(i) for i in range(4)))
            if model is None:
                sure = [batch.column(4).to_numpy(zero_copy_only=False)] * 2
            else:
                text, meta, _ = model.scores(model.evidence(f))
                sure = [np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1)) for p in (meta, text)]
            for view, label in enumerate(sure):
                f.count(counts, view, label)
                handed[view] += int((label >= 0).sum())
        k, place = np.nonzero(counts)
        k, place, n = (np.r_[a, b] for a, b in ((k, [2, 3]), (place, [0, 0]), (counts[k, place], handed)))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "place", "n"])

    label = F.col("label") if model is None else F.lit(-1)
    parts = rows.select(*_PARTS, label.cast("int").alias("label")).mapInArrow(lean(run), "k int, place int, n bigint")
    table = parts.groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()  # at most two rows a place
    k, place, n = (table[c].to_numpy() for c in ("k", "place", "n"))
    counts, handed = np.zeros((2, _SIZE), np.int64), [0, 0]
    counts[k[k < 2], place[k < 2]] = n[k < 2]
    for view in (0, 1):
        handed[view] = int(n[k == 2 + view].sum())
    return counts, handed


def _evidence(rows: DataFrame, model: CoTrained) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, labels) of the rows, ordered by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.evidence(Features(*(batch.column(i) for i in range(4))))
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), *(pa.array(x[:, i]) for i in (1, 2, 3))], ["doc_id", "label", "a", "b", "c"])

    parts = rows.select(*_PARTS, "doc_id", F.col("label").cast("int").alias("label"))
    found = parts.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, a double, b double, c double").orderBy("doc_id").toPandas()
    x = found[["a", "b", "c"]].to_numpy(float).reshape(-1, 3)
    return np.c_[np.ones(len(x)), x], found["label"].to_numpy(float)


def _flat(share: float | None) -> CoTrained:
    logit = 30.0 if share is None else float(np.clip(np.log((share + 1e-13) / (1 - share + 1e-13)), -30, 30))
    return CoTrained(np.zeros(_SIZE), [np.array([logit, 0, 0]), np.array([logit, 0])], np.array([logit, 0, 0]))


def fit(rows: DataFrame, labels: DataFrame, scratch: Scratch, *, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """``rows``: of :func:`featured`, in a table; ``labels``: doc_id, quality."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = scratch.keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))  # bounded by the parameter
    one = F.min(F.struct(*_PARTS)).alias("f")  # of rows that repeat a doc_id, one
    taught = scratch.keep(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one).select("doc_id", "label", "f.*", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 3).alias("back")))
    n = {(r.label, r.back): r["count"] for r in taught.groupBy("label", "back").count().collect()}
    if not all(n.get((k, False), 0) + n.get((k, True), 0) for k in (0, 1)):
        total = sum(n.values())
        return _flat((n.get((1, False), 0) + n.get((1, True), 0)) / total if total else None)
    split = all(n.get((k, b), 0) for k in (0, 1) for b in (False, True))
    fits, back = (taught.where(~F.col("back")), taught.where("back")) if split else (taught, taught)
    base, _ = _counts(fits, None)
    model = CoTrained(_weights(base), [], np.zeros(3))
    model.calibrate(*_evidence(back, model))
    free, handed = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti"), []
    for _ in range(rounds):
        more, given = _counts(free, model)
        handed.append(tuple(given))
        model = CoTrained(_weights(base + more), [], np.zeros(3), handed)
        model.calibrate(*_evidence(back, model))
    return model


def classify(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """doc_id, text_score, metadata_score, score (of quality 1), predicted."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(featured(docs, id_col=id_col, text_col=text_col, metadata=metadata))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.scores(model.evidence(Features(*(batch.column(i) for i in range(4)))))
            yield pa.RecordBatch.from_arrays([batch.column(4), *map(pa.array, found), pa.array((found[2] >= cut).astype(np.int32))], ["doc_id", "text_score", "metadata_score", "score", "predicted"])

    return rows.select(*_PARTS, "doc_id").mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_score double, metadata_score double, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """The rows predicted to be of quality 1, with all their columns. Texts are read again rather than joined back."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(featured(docs, id_col=id_col, text_col=text_col, metadata=metadata))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, scratch))
    scratch.only()
    _, names = _columns(docs, id_col, text_col, metadata)

    @F.pandas_udf("double")
    def quality(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        featurer, ints = Featurer(), pa.list_(pa.int32())
        for part in parts:
            meta = [metadata_places(dict(zip(names, values, strict=True))) for values in part.iloc[:, 1:].astype(object).itertuples(index=False)] if names else [[]] * len(part)
            columns = [list(c) for c in zip(*map(featurer.text, part["text"]), strict=True)] or [[], [], []]
            f = Features(*(pa.array(c, ints) for c in (*columns, meta)))
            yield pd.Series(shared.value.scores(shared.value.evidence(f))[2], dtype="float64")

    [score] = fresh_names(docs, "score")
    given = F.struct(F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"meta_{i}") for i, c in enumerate(names)))
    return docs.withColumn(score, quality(given)).where(F.col(score) >= cut).drop(score)
