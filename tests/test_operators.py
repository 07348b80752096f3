import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import chunk, docgen, evaluate, metadata, retrieve, spans
from attesta.operators.filters import FilterError, compile_filter
from attesta.plans.answer import answer_from_context, evidence
from attesta.sources import readers
from attesta.sources.store import Store
from attesta.streaming.ingest import ingest_stream


@pytest.mark.parametrize("bad", ["", "x ==", "nope == 1", 'a["k"] == 1', "a == 1 &&", "a == 1; drop", "a == b", '(a == 1'])
def test_filter_rejects(bad):
    with pytest.raises(FilterError):
        compile_filter(bad, ["a"], ())


def test_filter_paths(spark):
    df = spark.createDataFrame([(1, '{"year": 2020, "who": "Ann"}'), (2, '{"year": 1999}'), (3, None)], "id int, metadata string")
    hit = lambda f: [r.id for r in df.where(compile_filter(f, df.columns)).orderBy("id").collect()]
    assert hit('metadata["year"] > 2000') == [1]
    assert hit('metadata["who"] LIKE "%nn%" || id == 3') == [1, 3]
    assert hit("id in [2, 3] && not (id == 3)") == [2]


def test_dense_and_inverted_file(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 800)] + 0.3 * rng.normal(size=(800, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    queries = df.where("id % 50 = 0")
    exact = {(r.question_id, r.id) for r in retrieve.dense_topk(df, queries, 10).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(set(np.argsort(-(unit @ unit[q]))[:5]) <= {i for p, i in exact if p == q} for q in range(0, 800, 50))
    found = {(r.question_id, r.id) for r in retrieve.InvertedFile(df, 16).search(queries, 10, 6).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_inverted_file_recall_on_tables(spark):
    from attesta.plans.catalogue import QUERIES

    for sf in ("sf0.001", "sf0.01"):
        exact = {(r.question_id, r.id) for r in QUERIES["dense_topk"](spark, f"/root/testdata/{sf}").collect()}
        found = {(r.question_id, r.id) for r in QUERIES["dense_ivf"](spark, f"/root/testdata/{sf}").collect()}
        assert len(found & exact) / len(exact) >= 0.9


def test_weights_and_routes():
    assert retrieve.sanitise_weights({"dense": 2, "x": 1, "sparse": -1, "full_text": "3"}) == {"dense": 2.0}
    with pytest.raises(ValueError):
        retrieve.sanitise_weights({"dense": 0})
    assert retrieve.normalise_weights({"dense": 0, "sparse": 0}, ("dense", "sparse")) == {"dense": 0.5, "sparse": 0.5}
    assert retrieve.route(None, True, True) == "filter"
    assert retrieve.route("q", True, True) == "hybrid"
    with pytest.raises(ValueError):
        retrieve.route("q", True, False, "hybrid")


def test_rerank_tail(spark):
    hits = spark.createDataFrame([("q", str(i), i) for i in range(1, 6)], "question_id string, id string, rank int")
    got = retrieve.rerank(hits, F.col("rank"), 3).orderBy("new_rank").collect()
    assert [r.id for r in got] == ["3", "2", "1", "4", "5"]
    assert retrieve.rerank(hits, F.col("rank"), 3, keep_tail=False).count() == 3


def test_verify_exact(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat.")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "  mat  "), (4, ""), (5, "  ")], "span_id int, span string")
    assert {(r.span_id, r.start) for r in spans.verify_exact(docs, asked).collect()} == {(1, 4), (3, 19)}


def test_verify_exact_blocked(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_BYTES", 80)
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "nothing here")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "wo three four five six sev"), (2, "five six"), (3, "one three four five six")], "span_id int, span string")
    assert {r.span_id for r in spans.verify_exact(docs, asked).collect()} == {1, 2}


def test_verify_fuzzy(spark):
    docs = spark.createDataFrame([(1, "Before the cat , sat . after")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "THE CAT, SAT."), (2, "a dog ran far away")], "span_id int, span string")
    got = spans.verify_fuzzy(docs, asked).collect()
    assert [(r.span_id, r.source_text) for r in got] == [(1, "the cat , sat .")]


def test_highlights(spark):
    def marks(t, *s):
        r = spark.createDataFrame([(t, list(s))], "t string, s array<string>").select(spans.highlights(F.col("t"), F.col("s")).alias("m")).first()
        return [(m.text, m.start, m.end) for m in r.m]

    assert marks("The cat sat on the mat.", "cat") == [("cat", 4, 7)]
    assert marks("The big cat sat.", "big cat", "cat") == [("big cat", 4, 11)]
    assert marks("x a x", "x", "a") == [("x", 0, 1), ("a", 2, 3), ("x", 4, 5)]


def test_segments(spark):
    r = spark.createDataFrame([("a big cat", ["big"])], "t string, s array<string>").select(spans.segments(F.col("t"), spans.highlights(F.col("t"), F.col("s"))).alias("x")).first()
    assert [(s.text, s.highlighted) for s in r.x] == [("a ", False), ("big", True), (" cat", False)]


def test_citations(spark):
    rows = spark.createDataFrame([("q", 0, 1, "alpha"), ("q", 0, 5, "beta"), ("q", 1, 0, "gamma")], "question_id string, doc_index int, start int, text string")
    got = [(r.number, r.highlight_index, r.type) for r in spans.citations(rows, 2).orderBy("number").collect()]
    assert got == [(1, 0, "display"), (2, 1, "display"), (3, 0, "reference")]


def test_islands(spark):
    p = [0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 1, 1, 0]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(p)], "doc_id int, pos int, p double")
    assert [(r.first, r.last) for r in spans.token_islands(df).collect()] == [(1, 7)]


MARKDOWN = "pre\n# A\na\n## B\nb\n### C\nc\n## D\nd\n##### E\ne\n"


def test_markdown():
    got = chunk.Markdown().chunks(MARKDOWN)
    assert [c[2].split("\n")[0] for c in got] == ["pre", "# A", "## B", "### C", "## D"]
    assert got[3][3].startswith("# A\n## B\n\n### C") and got[4][4] == ["# A"]
    assert "".join(c[2] for c in got) == MARKDOWN
    assert "e\n" not in "".join(c[2] for c in chunk.Markdown(strict=True).chunks(MARKDOWN)).replace("pre\n", "").split("## D\nd\n")[1]
    assert chunk.Markdown().chunks("") == [] and len(chunk.Markdown().chunks("no header")) == 1


def test_markdown_sizes():
    rng = random.Random(0)
    for _ in range(50):
        t = "".join(rng.choice(["# H\n", "## I\n", "para " * rng.randrange(1, 30) + "\n\n", "x\n", "```\na\n\nb\n```\n\n", "| a | b |\n|---|---|\n| 1 | 2 |\n\nTable 1: cap\n\n"]) for _ in range(20))
        for options in (chunk.Markdown(smallest=30), chunk.Markdown(largest=80), chunk.Markdown(smallest=30, largest=80)):
            got = options.chunks(t)
            assert "".join(c[2] for c in got) == t or not t.strip()
            assert all(t[a:b] == raw for a, b, raw, _, _ in got)


def test_protected():
    t = "Table 1: c\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\ntext\n\n```\nx\n\ny\n```\n"
    assert [t[a:b].split("\n")[0] for a, b in chunk.protected_regions(t)] == ["Table 1: c", "```"]
    assert chunk.protected_regions("| a | b |\n| 1 | 2 |\n") == []


def test_recursive_chunks():
    t = "one two. three four.\nfive six\n\nseven " * 9
    got = chunk.recursive_chunks(t, 30)
    assert "".join(got) == t and max(map(len, got)) <= 30


def test_metadata(spark):
    df = spark.createDataFrame([({"a": "1", "user_id": "u", "page_no": "2"}, {"a": "9"})], "metadata map<string,string>, own map<string,string>")
    r = df.select(metadata.merge(F.col("metadata"), F.col("own")).alias("m")).first()
    assert r.m == {"a": "9", "user_id": "u", "page_no": "2"}
    r = df.select(metadata.footer(F.lit("body"), F.lit("T"), F.lit(""), F.col("metadata")).alias("x")).first()
    assert r.x == "# T\n\nbody\n\n---\nDocument: T\nA: 1\nPage No: 2"
    r = metadata.unknown_to_metadata(spark.createDataFrame([("i", "z")], "id string, extra string"), ("id",)).first()
    assert r.metadata == {"extra": "z"}


def test_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    assert tuple(evaluate.binary_scores(df, "y", "p").first()) == (0.5, 0.5, 0.5, 0.5)
    assert tuple(evaluate.binary_scores(df.where("y = 0 and p = 0"), "y", "p").first()) == (0.0, 0.0, 0.0, 1.0)


def test_docgen(spark):
    df = spark.createDataFrame([("d", "## S\nA [!query=what?| format=bullet, n=3] B [!QUERY=who] C")], "id string, text string")
    got = docgen.queries(df).orderBy("query_no").collect()
    assert [(r.question, dict(r.params), r.section) for r in got] == [("what?", {"format": "bullet", "n": "3"}, "S"), ("who", {}, "S")]
    assert df.select(docgen.fill(F.col("text"), F.array(F.lit("X"))).alias("x")).first().x == "## S\nA X B  C"


def test_context(spark):
    assert [r.id for r in readers.context_frame(spark, ["a", {"text": "b"}]).collect()] == ["ctx_0", "ctx_1"]
    with pytest.raises(TypeError):
        readers.coerce_context(42)
    with pytest.raises(ValueError):
        readers.coerce_context({"title": "t"})


def test_answer_from_context(spark):
    q = spark.createDataFrame([("q1", "Where is the big tower"), ("q2", "zzz")], "id string, text string")
    context = spark.createDataFrame([("c0", "The big tower is in Paris. It is old.")], "id string, text string")
    got = {r.question_id: r for r in answer_from_context(q, context).collect()}
    assert "The big tower is in Paris." in got["q1"].answer and got["q1"].citations[0].number == 1
    assert "No relevant information" in got["q2"].answer
    assert evidence()(lambda _: ("draft", context))(q).where("question_id = 'q1'").first().draft == "draft"


def test_labelled_sentences(spark):
    df = spark.createDataFrame([("s", "q", [[("0a", "x"), ("0b", "y")]], ["0b"]), ("n", None, [[("0a", "x")]], [])], "id string, question string, documents array<array<struct<key:string,text:string>>>, relevant_keys array<string>")
    assert [(r.text, r.relevant) for r in readers.labelled_sentences(df).collect()] == [("x", False), ("y", True)]


def test_files_and_records(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T")
    (tmp_path / "b.html").write_text("<p>x &amp; y</p><script>no</script>")
    (tmp_path / "c.bin").write_text("no")
    got = {r.title: (r.content_type, r.raw_content) for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a": ("markdown", "# T"), "b": ("html", "x & y")}
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_records(spark, str(tmp_path / "r.jsonl"), "a int").collect()) == [1, 2]


def test_store_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 300, "txt") for i in range(3)], "id long, text string, content_type string")
    docs.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), "id long, text string, content_type string", store, str(tmp_path / "cp")).awaitTermination()
    assert store.read("documents").count() == 3 and store.read("chunks").count() == 12
    store.add("documents", docs.withColumnRenamed("text", "raw_content"))
    assert store.read("documents").count() == 3
    assert store.chunks_of(1).count() == 4 and store.document(1).count() == 1
    assert store.scan("document_id == 1 && chunk_number > 0", 10).count() == 3
    store.delete_documents(spark.createDataFrame([(1,)], "id long"))
    assert store.read("chunks").count() == 8 and store.inspect().first().chunks == 8


def test_structured_answer(spark):
    from attesta.plans.answer import answer_structured, placeholder_hints, valid_questions

    template = "Place: [LOCATION]\nAge: [TOWER_AGE]\nNone: [COLOUR]"
    assert placeholder_hints(template, {"COLOUR": "paint"}) == {"LOCATION": "location", "TOWER_AGE": "tower age", "COLOUR": "paint"}
    q = spark.createDataFrame([(1, "tower"), (2, "zzz")], "id int, text string")
    corpus = spark.createDataFrame([("c0", "The location of the tower is Paris. The tower age is known. Nothing else.")], "id string, text string")
    got = {r.question_id: r.answer for r in answer_structured(q, corpus, template).collect()}
    assert "[1] The location of the tower is Paris." in got[1] and "The tower age is known." in got[1]
    assert got[2].endswith("None: (no relevant information found)")
    asked = spark.createDataFrame([(1, "ok"), (2, "  "), (3, None), (4, "x" * 1001)], "id int, text string")
    assert [r.id for r in valid_questions(asked).collect()] == [1]


def test_structured_shapes(spark):
    from attesta.operators import structured

    raw = '{"A": ["plain", {"text": "t", "doc": 1}, {"doc": 2}, 5], "B": []}'
    r = spark.createDataFrame([(raw,), ("not json",)], "raw string").select(structured.normalise(F.col("raw")).alias("v")).collect()
    assert [(s.text, s.doc) for s in r[0].v["A"]][:2] == [("plain", 0), ("t", 1)] and r[1].v == {}
    docs = F.array(F.lit("has t here"), F.lit("plain"))
    spans_ = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(d).alias("doc")) for t, d in (("t", 0), ("t", 0), ("plain", 1), ("t", 9), ("no", 0))])
    assert [(s.text, s.doc) for s in spark.range(1).select(structured.verified(spans_, docs).alias("x")).first().x] == [("t", 0), ("plain", 1)]
    hits = spark.createDataFrame([('{"a": "1"}', "d"), ("junk", None), (None, None)], "metadata string, document_id string")
    assert [dict(r.metadata) for r in structured.hits_to_results(hits).collect()] == [{"a": "1", "document_id": "d"}, {"raw": "junk"}, {}]
    assert spark.range(1).select(structured.citation_markers(F.lit("a [2] `[3]` [14]")).alias("x")).first().x == [2, 14]


def test_sentence_classifier(spark):
    from attesta.operators import classify

    rows = spark.createDataFrame([("red fox den", f"the red fox has a den {i}", True) for i in range(20)] + [("red fox den", f"stock prices fell {i}", False) for i in range(20)], "question string, text string, relevant boolean")
    out = classify.score(classify.fit(rows), rows).collect()
    assert all(r.relevant_predicted == r.relevant for r in out)


def test_documents_and_batches(spark, tmp_path):
    from attesta.plans import documents
    from attesta.plans.extensions import HashEmbedder, OverlapReranker, completion, embedding, model_extractor, rerank_scores, with_chunks
    from attesta.streaming.ingest import write_ndjson

    corpus = spark.createDataFrame([("c", "The big tower is in Paris. It is old.")], "id string, text string")
    t = spark.createDataFrame([("d", "# R\n[!query=where is the big tower| format=bullet]\nend"), ("e", "none"), ("f", "x [!query=zzz] y")], "id string, text string")
    got = {r.document_id: r.text for r in documents.process(t, corpus).collect()}
    assert "• [1] The big tower is in Paris." in got["d"] and got["f"] == "x No relevant information found. y" and got["e"] == "none"
    stages = documents.stages(t, documents.process(t, corpus)).where("document_id = 'd'").orderBy("seq").collect()
    assert [s.type for s in stages] == ["queries_found", "query_start", "query_complete", "document"]
    records = spark.createDataFrame([("where is the tower", ["The tower is here.", "Else."]), ("zz", [])], "question string, context array<string>")
    out = documents.answer_records(records)
    told = {r.question: r.answer for r in out.collect()}
    assert "The tower is here." in told["where is the tower"] and "No relevant information" in told["zz"]
    write_ndjson(out.select("question", "answer"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2

    class Model:
        def complete(self, prompt):
            if "fail" in prompt:
                raise RuntimeError("no")
            return '["The big tower is in Paris.", "made up"]'

    class Lines:
        def chunk(self, text):
            return [(x, "> " + x) for x in text.split(". ")]

    assert with_chunks(corpus, Lines()).count() == 2
    row = corpus.select(embedding(F.col("text"), HashEmbedder(8)).alias("v"), rerank_scores(F.lit("big tower"), F.col("text"), OverlapReranker()).alias("s"), completion(F.lit("fail"), Model()).alias("c")).first()
    assert len(row.v) == 8 and row.s == 1.0 and "error" in row.c
    q = spark.createDataFrame([("q", "tower")], "id string, text string")
    from attesta.plans.answer import answer

    cites = answer(q, corpus, extractor=model_extractor(Model(), "{{ question }} {{ document }}")).first().citations
    assert [c.text for c in cites] == ["The big tower is in Paris."]


def misspelt(rng, text, share):
    return "".join(rng.choice("abcdefghij") if c != " " and rng.random() < share else c for c in text)


def test_verify_fuzzy_recall(spark):
    """Spans with wrong characters in most of their words, against an aligner that sees every pair."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(12)]
    asked = []
    for i, t in enumerate(texts):
        w = t.split()
        at = rng.randrange(50)
        asked.append((i, misspelt(rng, " ".join(w[at : at + 20]), 0.05 + 0.012 * i)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    every = {(d, s) for d, t in enumerate(texts) for s, q in asked if spans.fuzzy_span(q, t)}
    got = {(r.doc_id, r.span_id) for r in spans.verify_fuzzy(docs, spark.createDataFrame(asked, "span_id int, span string")).collect()}
    assert got <= every and len(got) >= 0.9 * len(every) and len(every) >= 9


def test_fuzzy_span_against_all_windows():
    """The strided search finds as good a window as trying all."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    for _ in range(40):
        have = [word() for _ in range(60)]
        at, n = rng.randrange(35), rng.randrange(4, 25)
        span = misspelt(rng, " ".join(have[at : at + n]), 0.15)
        width = len(span.split())
        best = max((s for a in range(60) for k, s in enumerate(spans._window_scores(span, have[a : a + width + width // 4 + 1]), 1) if k >= max(1, width - width // 4 - 1)), default=0)
        found = spans.fuzzy_span(span, " ".join(have))
        assert (found is None) == (best < 0.8 - 1e-9) and (found is None or found[2] >= best - 1e-9)


def test_aligner_against_all_windows(monkeypatch):
    """Many pairs at once give what trying every window gives: the best, and the first of equal ones."""
    monkeypatch.setattr(spans, "LANE", 128)
    monkeypatch.setattr(spans, "WAITING", 20_000)
    rng = random.Random(8)
    for least, letters in ((0.8, "abcde"), (0.8, "".join(map(chr, range(0x4E00, 0x4F00)))), (0.6, "abcdefghij"), (0.95, "ab"), (0.05, "abc")):
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))  # noqa: E731, B023
        have = [[word() for _ in range(rng.choice((0, 1, 40, 150)))] for _ in range(7)]
        have.append(have[-1] * 2)
        asked = ["".join(rng.choice(letters) if rng.random() < 0.12 and c != " " else c for c in " ".join(h[a : a + n])) for h in have if h for n in (1, 5, 30, 90) for a in [rng.randrange(max(1, len(h) - n))]]
        got = {(k, i): v for k, i, v in spans._Aligner(asked, least).find([" ".join(h) for h in have], [list(range(len(asked)))] * len(have))}
        close = 0
        for k, h in enumerate(have):
            text, places = " ".join(h), [0]
            for w in h:
                places.append(places[-1] + len(w) + 1)
            for i, span in enumerate(asked):
                width = len(span.split())
                tried = [(s, -a, -n) for a in range(len(h)) for n, s in enumerate(spans._window_scores(span, h[a : a + width + width // 4 + 1]), 1) if n >= max(1, width - width // 4 - 1)]
                s, a, n = max(tried, default=(0, 0, 0))
                want = (text.find(span), text.find(span) + len(span), 1.0) if span in text else (places[-a], places[-a - n] - 1, s) if s >= least - 1e-9 and tried else None
                assert got.get((k, i)) == want
                close += want is not None and want[2] < 1
        assert close


def test_joined_tokens():
    """Each character between letters, and some texts that folding or normalising changes."""
    texts = [f"A{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for t in [*texts, "", "Cafe\u0301 Straße, ﬁne.\nŉ \u0345x", "ΣΑΣ (Ångström)"]:
        assert spans.joined_tokens(t) == " ".join(spans.token_offsets(t)[0])


def test_verify_fuzzy_of_many_candidates(spark):
    """Texts of the same words are candidates of every span; they are told apart in far less time than by all windows."""
    import time

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    texts = [[rng.choice(words) for _ in range(5000)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    asked = [(i, " ; ".join(" ".join(texts[i][a + 10 * k : a + 10 * k + 10]) for k in range(3)).upper()) for i in range(40) for a in [50 * i]]
    asked = spark.createDataFrame(asked, "span_id int, span string")
    assert spans.fuzzy_candidates(docs, asked).count() > 800
    began = time.time()
    got = spans.verify_fuzzy(docs, asked).collect()
    assert time.time() - began < 30
    assert {(r.doc_id, r.span_id, r.source_text) for r in got} == {(i, i, " ".join(texts[i][50 * i : 50 * i + 30])) for i in range(40)}


def test_fuzzy_candidates_of_a_long_text(spark):
    """Time grows with a text's length, not with its square."""
    import time

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a text of nothing")], "doc_id int, text string")
    asked = spark.createDataFrame([(5, " ".join(words[50_000:50_020]).upper()), (6, "zzzz yyyy xxxx zzyy")], "span_id int, span string")
    began = time.time()
    assert [tuple(r) for r in spans.fuzzy_candidates(docs, asked).collect()] == [(1, 5)]
    assert time.time() - began < 30
