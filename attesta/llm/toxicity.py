"""Toxicity by a linear-chain conditional random field over words.

Training rows are the labelled documents outside the held-out fold (crc32 of the doc_id as text, modulo 4, is 2): per
class at most ``SAMPLE`` documents of least hash, with their whole texts, which stay on the executors. Words that stand
in far more toxic than clean documents (likelihood ratio) label the tokens of toxic documents as toxic, and the field is
fitted to all sentences of these documents by its exact gradient. Features of a token are the lexicon's words and
beginnings of words that match it, the word before it and the word behind it; one weight is every token's, and there
are transitions. A chain is a sentence; a sentence of more than ``CHAIN`` words is several, in the fit and in scores
alike. Chains without any word of the lexicon differ in length alone, so they are counted by length.

For every text, forward-backward gives each token's marginal. Tokens of at least ``SPAN`` form the offending spans; the
largest marginal, the expected number of toxic tokens and the number of spans give the document's score by a logistic
fit on the training rows, weighted back to all labels. A sentence without any word of the lexicon has the marginals of
the background, which reach no span: it adds nothing.

Defined results: null and empty texts get the score of a text without toxic words; without labels of both classes every
score is the share of toxic labels, or 0; rows that repeat a doc_id each get a row, and the least of their texts is the
one fitted; a null doc_id is not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch
from attesta.llm.spans import over_texts

#: Lengths of the beginnings that are features; most features of the lexicon; words kept by a worker; words of a chain.
BEGINNINGS, FEATURES, MEMO, CHAIN = (3, 4, 5, 6, 7), 2000, 400_000, 64
#: Training documents a class; marginal of an offending token; score from which a document is predicted toxic.
SAMPLE, SPAN, CUT = 1000, 0.5, 0.3
#: Least likelihood ratio of a word, and its least share of the largest for the lexicon and for the labels of tokens.
LEAST_RATIO, LEXICON_SHARE, LABEL_SHARE = 12.0, 0.04, 0.06

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def document_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features(w)}


def ratio(x: float, y: float, nt: int, nc: int) -> float:
    """Likelihood ratio of a feature in ``x`` of ``nt`` toxic and ``y`` of ``nc`` clean documents; 0 if it tells little.

    It tells little unless it favours toxic documents and stands in three of them or more.
    """
    if x < 3 or x * nc <= y * nt:
        return 0.0
    e = (x + y) / (nt + nc)
    cells = ((x, nt * e), (nt - x, nt * (1 - e)), (y, nc * e), (nc - y, nc * (1 - e)))
    return 2 * sum(o * math.log(o / m) for o, m in cells if o and m)


class Field:
    """Two labels. ``weights[0]`` is every token's; then come the lexicon's for a token's own word, for the word before
    it and for the word behind it; ``moves[a, b]`` are those of neighbours a, b."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.size = lexicon, len(lexicon) + 1
        self.weights, self.moves, self.start = np.zeros(3 * self.size), np.zeros((2, 2)), 0.0
        self.weights[0] = -2.0

    def ids(self, word: str) -> tuple[int, ...]:
        return tuple(i for i in map(self.lexicon.get, features(word)) if i)

    def in_context(self, words: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """The ids of each word of a sentence with those of its neighbours."""
        n, k = len(words), self.size
        return [(*own, *(k + i for i in (words[t - 1] if t else ())), *(2 * k + i for i in (words[t + 1] if t + 1 < n else ()))) for t, own in enumerate(words)]

    def _batch(self, theta: np.ndarray, f: np.ndarray, mask: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) per token and expected moves, over padded sentences of feature ids (0: none) that stand ``times``."""
        at, slot = np.nonzero(f.reshape(-1, f.shape[2]))
        return self._expected(theta, at, f.reshape(-1, f.shape[2])[at, slot], mask, times)

    def _expected(self, theta: np.ndarray, at: np.ndarray, ids: np.ndarray, mask: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The same from the features that there are: token ``at`` (counted through all sentences) has feature ``ids``."""
        k, (n, length) = len(self.weights), mask.shape
        w, m, start = theta[:k], np.exp(theta[k : k + 4].reshape(2, 2)), theta[-1]
        e = np.exp(np.clip(w[0] + np.bincount(at, w[ids], n * length).reshape(n, length), -30, 30))
        times = np.ones(n) if times is None else times
        fwd, bwd = np.ones((length, n, 2)), np.ones((length, n, 2))
        fwd[0, :, 1] = e[:, 0] * np.exp(start)
        fwd[0] /= fwd[0].sum(1, keepdims=True)
        for t in range(1, length):
            step = fwd[t - 1] @ m
            step[:, 1] *= e[:, t]
            fwd[t] = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), fwd[t - 1])
        pair = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            nxt = bwd[t + 1].copy()
            nxt[:, 1] *= e[:, t + 1]
            both = fwd[t][:, :, None] * m * nxt[:, None, :]
            pair += np.tensordot(np.where(mask[:, t + 1], times, 0.0), both / both.sum((1, 2), keepdims=True), 1)
            step = nxt @ m.T
            bwd[t] = np.where(mask[:, t + 1, None], step / step.sum(1, keepdims=True), bwd[t + 1])
        p = fwd * bwd
        p /= p.sum(2, keepdims=True)
        return np.where(mask, p[:, :, 1].T, 0.0), pair

    def fit(self, sentences: list[tuple[list[tuple[int, ...]], list[int], int]], steps: int = 120, rate: float = 0.2, decay: float = 0.3) -> None:
        """From sentences (ids of each token, labels, how often). Those of like length are padded together."""
        k, like = len(self.weights), {}
        for s in sentences:
            like.setdefault(len(s[0]).bit_length(), []).append(s)
        parts, seen, moved, first_label = [], np.zeros(k), np.zeros((2, 2)), 0.0
        for part in like.values():
            n, length = len(part), max(len(s[0]) for s in part)
            y, mask, times = np.zeros((n, length), bool), np.zeros((n, length), bool), np.array([t for _, _, t in part], float)
            for i, (s, of, _) in enumerate(part):
                y[i, : len(s)], mask[i, : len(s)] = of, True
            has = [(i * length + t, x) for i, (s, _, _) in enumerate(part) for t, ids in enumerate(s) for x in ids]
            at, ids = np.array(has, np.int64).reshape(-1, 2).T
            parts.append((mask, times, at, ids))
            seen += self._tally(y.astype(float), times, at, ids)
            pairs = (times[:, None] * mask[:, 1:]).ravel()
            moved += np.bincount((2 * y[:, :-1] + y[:, 1:]).ravel(), pairs, 4).reshape(2, 2)
            first_label += times @ y[:, 0]
        total, theta = sum(t for _, _, t in sentences), np.r_[self.weights, self.moves.ravel(), self.start]
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            grad = np.r_[seen, moved.ravel(), first_label]
            for mask, times, at, ids in parts:
                p, pair = self._expected(theta, at, ids, mask, times)
                grad -= np.r_[self._tally(p, times, at, ids), pair.ravel(), times @ p[:, 0]]
            grad = (grad - decay * theta) / total
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights, self.moves, self.start = theta[:k], theta[k : k + 4].reshape(2, 2), float(theta[-1])

    def _tally(self, p: np.ndarray, times: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        p = p * times[:, None]
        out = np.bincount(ids, p.ravel()[at], len(self.weights))
        out[0] = p.sum()
        return out

    def marginals(self, sentence: list[tuple[int, ...]]) -> list[float]:
        """P(label 1) per token of one sentence: forward and backward ratios of label 1 to label 0."""
        w = self.weights
        e = [math.exp(max(-30.0, min(30.0, w[0] + sum(w[i] for i in ids)))) for ids in sentence]
        (m00, m01), (m10, m11) = np.exp(self.moves).tolist()
        fwd, r = [], math.exp(self.start) * e[0]
        for x in e[1:]:
            fwd.append(r)
            r = x * (m01 + r * m11) / (m00 + r * m10)
        fwd.append(r)
        out, b = [0.0] * len(e), 1.0
        for t in range(len(e) - 1, -1, -1):
            z = fwd[t] * b
            out[t] = z / (1 + z)
            x = e[t] * b
            b = (m10 + m11 * x) / (m00 + m01 * x)
        return out


class Model:
    def __init__(self, field: Field | None, coef: np.ndarray):
        self.field, self.coef, self.memo = field, coef, {}

    def ids(self, word: str) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self.field.ids(word)
        return found

    def spans(self, text: str) -> tuple[list[tuple[int, int]], list[float]]:
        """Offending (start, end) in code points, and the document's features."""
        found, most, total = [], 0.0, 0.0
        if self.field is None:
            return found, [1.0, 0.0, 0.0, 0.0, 0.0]
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _WORD.findall(low)
        if not any(map(self.ids, set(words))):
            return found, [1.0, 0.0, 0.0, 0.0, 0.0]
        for sentence in _SENTENCE.finditer(low):
            parts = [self.ids(w) for w in _WORD.findall(sentence[0])]
            if not any(parts):
                continue
            p = []
            for start in range(0, len(parts), CHAIN):
                chain = parts[start : start + CHAIN]
                p += self.field.marginals(self.field.in_context(chain)) if any(chain) else [0.0] * len(chain)
            most = max(most, max(p))
            if max(p) < SPAN:
                continue
            last = -2
            for i, word in enumerate(_WORD.finditer(sentence[0])):
                if p[i] >= SPAN:
                    total += p[i]
                    a, b = (sentence.start() + x for x in word.span())
                    if i == last + 1:
                        found[-1] = (found[-1][0], b)
                    else:
                        found.append((a, b))
                    last = i
        share = math.log(total / len(words)) / 5 + 1 if total else 0.0
        return found, [1.0, most, math.log1p(total), math.log1p(len(found)), share]

    def score(self, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(x, self.coef), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first column is the constant and is not shrunk."""
    coef, shrink = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - shrink * coef)
        coef = coef + step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def sentence_rows(text: str, ids) -> Iterator[tuple[int, tuple, tuple]]:
    """(words, places, lexicon ids at these places) of each chain; ``ids`` maps a word to its lexicon ids."""
    for sentence in _SENTENCE.findall(text.lower()):
        words = [ids(w) for w in _WORD.findall(sentence)]
        for start in range(0, len(words), CHAIN):
            found = words[start : start + CHAIN]
            places = tuple(i for i, x in enumerate(found) if x)
            yield len(found), places, tuple(found[i] for i in places)


def choose(counted: Iterable[tuple[str, float]]) -> tuple[dict[str, int], set[int]]:
    """Lexicon and the ids whose tokens are labelled toxic, from the best features and their ratios, the largest first."""
    counted = list(counted)
    top = counted[0][1] if counted else 0.0
    known = [(w, r) for w, r in counted if r >= max(LEAST_RATIO, LEXICON_SHARE * top)][:FEATURES]
    return {w: i + 1 for i, (w, _) in enumerate(known)}, {i + 1 for i, (_, r) in enumerate(known) if r >= max(LEAST_RATIO, LABEL_SHARE * top)}


def fit_field(lexicon: dict[str, int], telling: set[int], counted: Iterable[tuple[int, tuple, tuple, int, int]]) -> Field:
    """From sentences (words, places, ids, label of the document, how often)."""
    field, sentences = Field(lexicon), []
    for n, places, ids, toxic, times in counted:
        own: list[tuple[int, ...]] = [()] * n
        for i, x in zip(places, ids, strict=True):
            own[i] = tuple(x)
        sentences.append((field.in_context(own), [int(toxic == 1 and not telling.isdisjoint(x)) for x in own], times))
    field.fit(sentences)
    return field


def fit_score(model: Model, rows: Iterable[tuple[list[float], int]], totals: dict[int, int]) -> Model:
    """The logistic fit from the documents' features and labels; ``totals``: labels of each class in all training rows."""
    rows = sorted(rows)
    x, y = np.array([r for r, _ in rows]), np.array([k for _, k in rows], float)
    weight = np.array([totals[k] / max(1, sum(1 for _, z in rows if z == k)) for k in (0, 1)])[y.astype(int)]
    model.coef = logistic(x, y, weight)
    return model


def flat_model(totals: dict[int, int]) -> Model:
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    return Model(None, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0, 0]))


def train(rows: list[tuple[str, int]], totals: dict[int, int]) -> Model:
    """As :func:`fit`, from (text, label) in memory."""
    distinct, flat = sorted(set(rows)), flat_model(totals)
    n = Counter(y for _, y in distinct)
    if not (n[0] and n[1]):
        return flat
    counts = Counter((f, y) for t, y in distinct for f in document_features(t))
    ratios = ((f, ratio(x, counts[f, 0], n[1], n[0])) for (f, y), x in counts.items() if y == 1)
    lexicon, telling = choose(sorted(((f, r) for f, r in ratios if r), key=lambda x: (-x[1], x[0]))[:FEATURES])
    if not lexicon:
        return flat
    words = Field(lexicon)
    sentences = Counter((*s, y) for t, y in distinct for s in sentence_rows(t, words.ids))
    model = Model(fit_field(lexicon, telling, ((*s, k) for s, k in sorted(sentences.items()))), flat.coef)
    return fit_score(model, [(model.spans(t)[1], y) for t, y in rows], totals)


def _per_text(rows: DataFrame, make, names: str, types: list[pa.DataType]) -> DataFrame:
    """``make()`` gives a function from (text, toxic) to rows; counted per task before anything is shuffled or fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, total = make(), Counter()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*total, strict=True)) or [[] for _ in types]
            out = pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, types, strict=True)), pa.array(list(total.values()), pa.int64())], [*(x.split()[0] for x in names.split(", ")), "times"])
            total.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total.update(one(text.as_py(), toxic))
                if len(total) > 100_000:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, f"{names}, times bigint")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """From at most ``sample`` labelled documents a class outside the held-out fold.

    To the driver come the lexicon, the sentences that have words of it (as ids), and five numbers a document.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    flat = flat_model(totals)
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.keep(docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    distinct = scratch.keep(rows.dropDuplicates(["text", "toxic"]).select("text", "toxic"))
    n = {r.toxic: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return flat

    counts = _per_text(distinct, lambda: lambda text, toxic: ((f, toxic) for f in document_features(text)), "feature string, toxic int", [pa.string(), pa.int32()])
    x, y = (F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("times"))), F.lit(0)).alias(name) for k, name in ((1, "x"), (0, "y")))
    counts = scratch.keep(counts.groupBy("feature").agg(x, y).where((F.col("x") >= 3) & (F.col("x") * n[0] > F.col("y") * n[1])))
    cell = lambda o, m: F.when(o > 0, o * F.ln(o / m)).otherwise(0.0)
    e = (F.col("x") + F.col("y")) / (n[0] + n[1])
    told = 2 * (cell(F.col("x"), n[1] * e) + cell(n[1] - F.col("x"), n[1] * (1 - e)) + cell(F.col("y"), n[0] * e) + cell(n[0] - F.col("y"), n[0] * (1 - e)))
    best = counts.select("feature", F.round(told, 9).alias("told")).orderBy(F.desc("told"), "feature").limit(FEATURES).collect()
    lexicon, telling = choose((r.feature, r.told) for r in best)
    if not lexicon:
        return flat

    def sentences():
        field, memo = Field(lexicon), {}

        def ids(word: str) -> tuple[int, ...]:
            if word not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = field.ids(word)
            return memo[word]

        return lambda text, toxic: ((*s, toxic) for s in sentence_rows(text, ids))

    ints = pa.list_(pa.int32())
    counted = _per_text(distinct, sentences, "n int, places array<int>, ids array<array<int>>, toxic int", [pa.int32(), ints, pa.list_(ints), pa.int32()])
    counted = counted.groupBy("n", "places", "ids", "toxic").agg(F.sum("times").alias("times")).collect()
    counted = sorted((r.n, tuple(r.places), tuple(map(tuple, r.ids)), r.toxic, r.times) for r in counted)
    model = Model(fit_field(lexicon, telling, counted), flat.coef)
    shared = spark.sparkContext.broadcast(model)
    numbers = _per_text(rows, lambda: lambda text, toxic: ((tuple(shared.value.spans(text)[1]), toxic),), "x array<double>, toxic int", [pa.list_(pa.float64()), pa.int32()])
    return fit_score(model, [(list(r.x), r.toxic) for r in numbers.collect() for _ in range(r.times)], totals)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, spans (``start:end``, comma-joined, in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample))

    def make():
        model = shared.value

        def row(text: str) -> tuple:
            found, x = model.spans(text)
            return model.score(x), ",".join(f"{a}:{b}" for a, b in found)

        return row

    return over_texts(docs, make, [("score", "double", pa.float64()), ("spans", "string", pa.string())], id_col=id_col, text_col=text_col)
