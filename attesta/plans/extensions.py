"""What users can plug in, and the deterministic stand-ins. Models are pandas functions inside the same plans."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.templates import PROMPTS, render
from attesta.functions.templates import prompt as prompt_column


class Chunker(Protocol):
    def chunk(self, text: str) -> list[tuple[str, str]]:
        """(raw, enhanced) chunks in order."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SparseEmbedder(Protocol):
    def embed(self, texts: list[str]) -> list[dict[int, float]]: ...


class Reranker(Protocol):
    def score(self, question: str, texts: list[str]) -> list[float]: ...


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashEmbedder:
    """Signed feature hashing of words into a unit vector; the same text always gives the same vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


class HashSparseEmbedder:
    """Weights of a hashed bag of words, 1 + ln(count); the places are those of the SQL side's sparse vectors."""

    def __init__(self, size: int = 30522):
        self.size = size

    def embed(self, texts: list[str]) -> list[dict[int, float]]:
        out = []
        for t in texts:
            counts: dict[int, int] = {}
            for w in re.findall(r"\w+", (t or "").lower()):
                place = int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % self.size
                counts[place] = counts.get(place, 0) + 1
            out.append({k: 1 + math.log(n) for k, n in counts.items()})
        return out


class OverlapReranker:
    def score(self, question: str, texts: list[str]) -> list[float]:
        asked = set(question.lower().split())
        return [len(asked & set((t or "").lower().split())) / max(1, len(asked)) for t in texts]


def with_chunks(docs: DataFrame, chunker: Chunker, *, ident: str = "id", text: str = "text") -> DataFrame:
    kind = docs.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, raw, enhanced) for d, t in zip(f["document_id"], f["text"], strict=True) for i, (raw, enhanced) in enumerate(chunker.chunk(t or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_number", "text", "enhanced_text"])

    return docs.select(F.col(ident).alias("document_id"), F.col(text).alias("text")).mapInPandas(run, f"document_id {kind}, chunk_number int, text string, enhanced_text string")


def embedding(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(embedder.embed(p.tolist()))

    return run(text)


def sparse_embedding(text: Column, embedder: SparseEmbedder) -> Column:
    """Sparse vectors as maps of place to weight."""

    @F.pandas_udf("array<struct<key:int,value:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([[{"key": int(k), "value": float(v)} for k, v in sorted(x.items())] for x in embedder.embed(p.tolist())], dtype="object")

    return F.map_from_entries(run(text))


def rerank_scores(question: Column, text: Column, reranker: Reranker) -> Column:
    """Scores by the reranker; a failing reranker gives nulls, which leave the retrieval order."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series([reranker.score(a, [b])[0] for a, b in zip(q, t, strict=True)], dtype="float64")
        except Exception:  # noqa: BLE001
            return pd.Series([None] * len(q), dtype="float64")

    return run(question, text)


def completion(prompt: Column, completer: Completer) -> Column:
    """Model output a row; an error is a row of JSON with ``error``, so one bad call does not end the job."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            try:
                return completer.complete(x)
            except Exception as e:  # noqa: BLE001
                return json.dumps({"error": str(e)})

        return p.map(one)

    return run(prompt)


def model_extractor(completer: Completer, prompt: str) -> Callable[[Column, Column], Column]:
    """An extractor for :func:`attesta.plans.answer.answer`: the model lists spans as a JSON array; bad JSON gives none."""

    def extract(question: Column, text: Column) -> Column:
        filled = F.replace(F.replace(F.lit(prompt), F.lit("{{ question }}"), question), F.lit("{{ document }}"), text)
        return F.coalesce(F.from_json(completion(filled, completer), "array<string>"), F.array().cast("array<string>"))

    return extract


class ModelExtractor:
    """Spans by a model, for :func:`attesta.plans.answer.answer`.

    ``batch``: a question's documents are asked for together, ``size`` at a time, as ``doc_0``, ``doc_1`` and so on;
    ``individual``: one at a time; ``auto``: together if they fit into one batch. A batch whose answer fails or is not
    JSON is asked for again one document at a time; a document that fails has no spans. ``prompt`` may name
    ``{{ question }}`` and ``{{ documents }}``.
    """

    def __init__(self, completer: Completer, mode: str = "auto", size: int = 5, prompt: str | None = None):
        if mode not in ("batch", "individual", "auto"):
            raise ValueError(f"extraction mode {mode!r} is not batch, individual or auto")
        self.completer, self.mode, self.size, self.prompt = completer, mode, size, prompt or PROMPTS["extract"]

    def _ask(self, question: str, texts: list[str]) -> list[list[str]]:
        listed = "\n\n".join(f"[doc_{i}]\n{t}" for i, t in enumerate(texts))
        found = json.loads(self.completer.complete(render(self.prompt, {"question": question, "documents": listed})))
        return [[s for s in found.get(f"doc_{i}", []) if isinstance(s, str)] for i in range(len(texts))]

    def spans(self, question: str, texts: list[str]) -> list[list[str]]:
        together = self.mode == "batch" or (self.mode == "auto" and len(texts) <= self.size)
        out: list[list[str]] = []
        for start in range(0, len(texts), self.size if together else 1):
            part = texts[start : start + (self.size if together else 1)]
            try:
                out += self._ask(question, part)
            except Exception:  # noqa: BLE001  the model is the caller's
                for t in part:
                    try:
                        out += self._ask(question, [t])
                    except Exception:  # noqa: BLE001
                        out.append([])
        return out

    def extract(self, rows: DataFrame) -> DataFrame:
        """``rows`` (question_id, question, rank, __text, …) with a column ``spans``."""

        @F.pandas_udf("array<array<string>>")
        def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([self.spans(q, [x or "" for x in t]) for q, t in zip(questions, texts, strict=True)], dtype="object")

        one = F.struct("rank", "id", F.col("__text").alias("text"))
        asked = rows.groupBy("question_id", "question").agg(F.array_sort(F.collect_list(one)).alias("docs"))
        asked = asked.withColumn("found", run(F.col("question"), F.transform("docs", lambda d: d["text"])))
        pairs = asked.select("question_id", F.explode(F.arrays_zip(F.transform("docs", lambda d: d["id"]).alias("id"), F.col("found").alias("spans"))).alias("x"))
        return rows.join(pairs.select("question_id", "x.id", F.coalesce("x.spans", F.array().cast("array<string>")).alias("spans")), ["question_id", "id"])


def intent_detector(completer: Completer, intents: dict[str, list[str]], prompt: str | None = None) -> Callable[[Column], Column]:
    """A detector for :func:`attesta.operators.intent.decide`: a model's JSON for each question, from example questions."""
    listed = "\n".join(f"{name}: {'; '.join(examples)}" for name, examples in intents.items())
    return lambda question: completion(prompt_column(prompt or PROMPTS["intent"], question=question, intents=listed), completer)


def completing(completer: Completer) -> Callable[[Column], Column]:
    """A model as the ``complete`` of strategies and structured answers: a failed call gives null."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            try:
                return completer.complete(x)
            except Exception:  # noqa: BLE001
                return None

        return p.map(one)

    return run
