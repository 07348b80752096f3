"""Question answering as one plan: intent, retrieve, rerank, pick spans, verify, highlight, cite, fill a template.

Questions are rows; one job answers all of them. Retriever, extractor, reranker, intent detector and template strategy
are arguments with deterministic lexical stand-ins; those are not a match for models.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.templates import PRESETS, PROMPTS, Strategy, fill, fill_structured, placeholder_hints, prompt
from attesta.functions.text import clean_answer, sentences, strip, tokens
from attesta.operators import structured
from attesta.operators.filters import compile_filter
from attesta.operators.retrieve import BLOCK, bm25_topk, rerank
from attesta.operators.spans import fuzzy_span, highlights

Extractor = Callable[[Column, Column], Column]


def lexical_extractor(question: Column, text: Column, least: float = 0.2, most: int = 3) -> Column:
    """Sentences of ``text`` that share at least ``least`` of the question's words, the best first, at most ``most``."""
    asked = F.array_distinct(tokens(question))
    scored = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(s)), asked)) / F.greatest(F.size(asked), F.lit(1))).alias("score"), i.alias("i"), s.alias("s")))
    good = F.array_sort(F.filter(scored, lambda x: x["score"] <= -least))
    return F.array_distinct(F.transform(F.slice(good, 1, most), lambda x: x["s"]))


def verified_spans(spans: Column, text: Column, mode: str = "exact", least: float = 0.8) -> Column:
    """Spans, stripped, that stand in the text; ``fuzzy`` gives the text's own words for those that nearly do."""
    if mode == "exact":
        return F.filter(F.transform(spans, strip), lambda s: (s != "") & F.contains(text, s))
    if mode != "fuzzy":
        raise ValueError(f"verification is 'exact' or 'fuzzy', not {mode!r}")

    @F.pandas_udf("array<string>")
    def near(s: pd.Series, t: pd.Series) -> pd.Series:
        def one(found, body) -> list[str]:
            places = [fuzzy_span(x.strip(), body or "", least) for x in (found if found is not None else ()) if x and x.strip()]
            return [body[p[0] : p[1]] for p in places if p]

        return pd.Series([one(a, b) for a, b in zip(s, t, strict=True)], dtype="object")

    return near(spans, text)


def gather(questions: DataFrame, corpus: DataFrame, *, k: int = 5, filter: str | None = None, extractor=lexical_extractor, retrieve: Callable[..., DataFrame] | None = None, reranker=None, rerank_k: int = 50, keep_tail: bool = True, verify: str = "exact") -> DataFrame:
    """question_id, question, docs: for each question its documents in order, with verified spans and highlights.

    A question without a document has an empty list.

    ``questions``: id, text; ``corpus``: id, text and other columns, which ``filter`` may name. ``extractor`` is a function
    of two columns, or has ``extract(rows)``, which gives the rows a column ``spans``.
    """
    if retrieve is None:
        where = None if filter is None else compile_filter(filter, corpus.columns)
        hits = bm25_topk(corpus, questions, k, where=where)
    else:
        base = corpus if filter is None else corpus.where(compile_filter(filter, corpus.columns))
        hits = retrieve(base, questions, k)
    extra = [c for c in ("title", "source") if c in corpus.columns]
    texts = corpus.select("id", F.col("text").alias("__text"), *extra)
    rows = hits.select("question_id", "id", "score", "rank").join(texts, "id").join(questions.select(F.col("id").alias("question_id"), F.col("text").alias("question")), "question_id")
    if reranker is not None:
        from attesta.plans.extensions import rerank_scores

        rows = rerank(rows, rerank_scores(F.col("question"), F.col("__text"), reranker), rerank_k, keep_tail).drop("rank", "rerank_score").withColumnRenamed("new_rank", "rank")
    rows = extractor.extract(rows) if hasattr(extractor, "extract") else rows.withColumn("spans", extractor(F.col("question"), F.col("__text")))
    blank = F.coalesce(strip(F.col("__text")), F.lit("")) == ""
    rows = rows.withColumn("spans", F.when(blank, F.array().cast("array<string>")).otherwise(verified_spans(F.col("spans"), F.col("__text"), verify)))
    rows = rows.withColumn("marks", highlights(F.col("__text"), F.col("spans")))
    doc = F.struct("rank", "id", "score", F.col("__text").alias("content"), "spans", "marks", *extra)
    grouped = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    asked = questions.select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    none = F.array().cast(grouped.schema["docs"].dataType)
    return asked.join(grouped, "question_id", "left").withColumn("docs", F.coalesce("docs", none))


def response(gathered: DataFrame, *, strategy: Strategy | None = None, template: str | None = None, display: int = 5, complete: Callable[[Column], Column] | None = None) -> DataFrame:
    """question_id, question, answer, documents, highlights, citations from :func:`gather`'s rows."""
    strategy = strategy or Strategy(templates=[template or PRESETS["plain"]])
    extra = [f.name for f in gathered.schema["docs"].dataType.elementType.fields if f.name in ("title", "source")]
    spans = F.flatten(F.transform("docs", lambda d: d["spans"]))
    cites = F.flatten(F.transform("docs", lambda d, i: F.transform(d["marks"], lambda m, j: F.struct(m["text"].alias("text"), i.alias("doc_index"), j.alias("highlight_index")))))
    out = gathered.withColumn("__spans", spans).withColumn("__cites", cites)
    shown, rest = F.slice("__spans", 1, display), F.slice("__spans", display + 1, F.greatest(F.size("__spans"), F.lit(1)))
    out = out.withColumn("__template", strategy.template_for(F.col("question"), F.col("__spans"), F.size(rest), complete=complete))
    numbered = F.transform("__cites", lambda c, n: F.struct(c["text"].alias("text"), c["doc_index"].alias("doc_index"), c["highlight_index"].alias("highlight_index"), (n + 1).alias("number"), F.when(n < display, "display").otherwise("reference").alias("type")))
    return out.select(
        "question_id",
        "question",
        clean_answer(fill(F.col("__template"), shown, rest, strategy.citation_style, strategy.citation_format)).alias("answer"),
        F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["score"].alias("score"), d["content"].alias("content"), *[d[c].alias(c) for c in extra])).alias("documents"),
        F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["marks"].alias("marks"))).alias("highlights"),
        numbered.alias("citations"),
    )


def answer(questions: DataFrame, corpus: DataFrame, *, k: int = 5, template: str | None = None, strategy: Strategy | None = None, display: int = 5, complete: Callable[[Column], Column] | None = None, intent: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """question_id, question, answer, documents, highlights, citations. ``options`` are those of :func:`gather`.

    A span that is not in its document is dropped before anything is shown. ``intent`` gives each question a struct with
    ``route`` and ``answer``; a route other than ``continue`` ends with that answer, without retrieval.
    """
    ended = None
    if intent is not None:
        decided = questions.withColumn("__d", intent(F.col("text")))
        direct = F.col("__d.route").isNotNull() & (F.col("__d.route") != "continue")
        said = F.col("__d.answer") if "answer" in [f.name for f in decided.schema["__d"].dataType.fields] else F.lit("")
        ended = decided.where(direct).select(F.col("id").alias("question_id"), F.col("text").alias("question"), clean_answer(F.coalesce(said, F.lit(""))).alias("answer"))
        questions = decided.where(~direct).drop("__d")
    found = response(gather(questions, corpus, k=k, **options), strategy=strategy, template=template, display=display, complete=complete)
    if ended is None:
        return found
    none = [F.array().cast(found.schema[c].dataType).alias(c) for c in ("documents", "highlights", "citations")]
    return found.unionByName(ended.select("question_id", "question", "answer", *none))


def given_context(context: DataFrame) -> Callable[..., DataFrame]:
    """A retriever that gives all context rows, ranked by id: a question's own (``question_id``), or all of them to each.

    Questions are taken in blocks of ``BLOCK``, as constants beside the rows; context is neither cut nor collected.
    """

    def given(corpus: DataFrame, asked: DataFrame, _: int) -> DataFrame:
        if "question_id" in context.columns:
            rows = context.select("question_id", "id").join(asked.select(F.col("id").alias("question_id")), "question_id", "left_semi")
        else:
            ids, kind, rows = asked.select("id"), asked.schema["id"].dataType, None
            parts = max(1, -(-ids.count() // BLOCK))
            for i in range(parts):
                block = [r.id for r in ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).collect()]
                part = corpus.select(F.explode(F.array(*map(F.lit, block)).cast(f"array<{kind.simpleString()}>")).alias("question_id"), "id")
                rows = part if rows is None else rows.unionByName(part)
        order = W.partitionBy("question_id").orderBy("id")
        return rows.withColumn("rank", F.row_number().over(order)).withColumn("score", F.lit(1.0))

    return given


def answer_from_context(questions: DataFrame, context: DataFrame, **options) -> DataFrame:
    """As :func:`answer`, over given context rows (id, text) for every question, without retrieval."""
    return answer(questions, context, retrieve=given_context(context), **options)


def evidence(display: int = 5):
    """Decorator: a function that returns context rows, or a tuple (answer text, context rows), gives a full answer."""

    def wrap(f):
        @wraps(f)
        def run(questions: DataFrame, *args, **kwargs) -> DataFrame:
            out = f(questions, *args, **kwargs)
            if isinstance(out, tuple) and len(out) == 2 and isinstance(out[0], str):
                return answer_from_context(questions, out[1], display=display).withColumn("draft", F.lit(out[0]))
            return answer_from_context(questions, out, display=display)

        return run

    return wrap


def answer_structured(questions: DataFrame, corpus: DataFrame, template: str, *, k: int = 5, hints: dict[str, str] | None = None, style: str = "inline", complete: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """question_id, answer: each placeholder is answered by spans of its own, in one job for all questions.

    Without a model, each placeholder adds its hint to the question and is answered by retrieval and extraction. With
    ``complete``, a model is asked once a question for the spans of all placeholders; its spans are verified.
    """
    wanted = placeholder_hints(template, hints)
    if not wanted:
        raise ValueError("the template has no semantic placeholder")
    if complete is not None:
        return _structured_by_model(questions, corpus, template, wanted, k, style, complete, options)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("hint")) for n, h in wanted.items()]))
    asked = questions.select(F.col("id").alias("__q"), "text", pairs.alias("p")).select("__q", "p.name", F.concat_ws("|", F.col("__q").cast("string"), "p.name").alias("id"), F.concat_ws(" ", "text", "p.hint").alias("text"))
    found = answer(asked.select("id", "text"), corpus, k=k, **options)
    texts = F.transform("citations", lambda c: F.struct(c["text"].alias("text"), c["doc_index"].alias("doc")))
    rows = asked.select("__q", "name", "id").join(found.select(F.col("question_id").alias("id"), F.array_distinct(texts).alias("spans")), "id", "left")
    empty = F.array().cast("array<struct<text:string,doc:int>>")
    values = rows.groupBy("__q").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("spans", empty)))).alias("values"))
    return values.select(F.col("__q").alias("question_id"), fill_structured(F.lit(template), F.col("values"), style).alias("answer"))


def _structured_by_model(questions: DataFrame, corpus: DataFrame, template: str, wanted: dict[str, str], k: int, style: str, complete, options: dict) -> DataFrame:
    none = lambda question, text: F.array().cast("array<string>")
    rows = gather(questions, corpus, k=k, extractor=none, **options)
    listed = F.array_join(F.transform("docs", lambda d, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), d["content"])), "\n\n")
    asked = prompt(PROMPTS["structured"], question=F.col("question"), template=template, hints="\n".join(f"{n}: {h}" for n, h in wanted.items()), documents=listed)
    made = rows.select("question_id", "question", F.transform("docs", lambda d: d["content"]).alias("contents"), complete(asked).alias("raw"))
    made = made.withColumn("values", F.transform_values(structured.normalise(F.col("raw")), lambda _, s: structured.verified(s, F.col("contents"))))
    spans = F.flatten(F.map_values("values"))
    by_doc = F.transform("contents", lambda c, i: F.array_distinct(F.transform(F.filter(spans, lambda s: s["doc"] == i), lambda s: s["text"])))
    return made.select("question_id", fill_structured(F.lit(template), F.col("values"), style).alias("answer"), by_doc.alias("spans_by_document"))


def valid_questions(questions: DataFrame, text: str = "text", longest: int = 1000) -> DataFrame:
    """The questions that are not blank and not too long; where there is a column ``k``, it must be at least one."""
    ok = (F.length(strip(F.coalesce(F.col(text), F.lit("")))) > 0) & (F.length(text) <= longest)
    return questions.where(ok & (F.coalesce(F.col("k"), F.lit(1)) >= 1) if "k" in questions.columns else ok)
