import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions.templates import POOL_FALLBACKS, Strategy
from attesta.operators import chunk, records, training
from attesta.plans import documents
from attesta.plans.answer import answer, answer_structured
from attesta.plans.extensions import HashSparseEmbedder, ModelExtractor, completing, sparse_embedding
from attesta.sources import readers
from attesta.sources.index import Index
from attesta.sources.store import Store, Table, checked_chunks


def test_index_lists_and_appends(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    rows = spark.createDataFrame([(i, f"text number {i % 40}", x.tolist(), i % 3) for i, x in enumerate(v)], "id long, text string, dense array<float>, kind int")
    index = Index(spark, str(tmp_path / "index"), lists=12)
    index.add_chunks(rows.where("id < 400"))
    index.add_chunks(rows)  # what is there is skipped
    assert index.store.read("chunks").count() == 600 and len(index.vectors._state()[1]["batches"]) == 2
    asked = rows.where("id % 50 = 0").select("id", "text", "dense")
    exact = {(r.question_id, r.id) for r in index.search(asked, 10, search_type="dense", exact=True).collect()}
    near = {(r.question_id, r.id) for r in index.search(asked, 10, search_type="dense", probes=4).collect()}
    assert len(exact) == 120 and len(near & exact) >= 0.9 * len(exact)
    # Only the files of probed lists are read.
    plan = index.search(asked.limit(1), 5, search_type="dense", probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1]
    hits = index.search(asked, 5, filter="kind == 1", weights={"dense": 1, "full_text": 1}).collect()
    assert hits and all(r.kind == 1 for r in hits) and all(abs(r.score - (1 - r.rrf_score)) < 1e-8 for r in hits)
    assert index.search(asked, 3).count() == 36  # dense and sparse are there: hybrid
    assert index.scan("kind == 2 && id > 100", 7).count() == 7
    with pytest.raises(ValueError):
        index.search(asked, 3, weights={"unknown": 1})
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "index"), full_text=False).search(asked, 3, search_type="full_text")


def test_index_answers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "The big tower is in Paris. It is old.", "x"), ("b", "The bridge is in London.", "y")], "id string, text string, who string")
    index = Index(spark, str(tmp_path / "i"), sparse=lambda c: sparse_embedding(c, HashSparseEmbedder()))
    index.add_chunks(rows)
    q = spark.createDataFrame([("q", "Where is the big tower"), ("r", "bridge in London")], "id string, text string")
    got = {r.question_id: r for r in answer(q, rows, k=1, retrieve=index.retriever(search_type="sparse")).collect()}
    assert got["q"].documents[0].id == "a" and "[1] The bridge is in London." == got["r"].answer
    none = answer(q, rows, k=1, retrieve=index.retriever(filter='who == "z"', search_type="full_text")).collect()
    assert len(none) == 2 and all("No relevant information" in r.answer for r in none)


def test_table_versions(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.append(spark.createDataFrame([(1, "a")], "id int, x string"))
    table.append(spark.createDataFrame([(2, "b", 7)], "id int, x string, more int"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", None), (2, "b", 7)]
    # Files without a version, as a crash leaves them, are not read.
    spark.createDataFrame([(9, "z", 0)], "id int, x string, more int").write.parquet(str(tmp_path / "t" / "batch-lost"))
    assert table.read().count() == 2
    with pytest.raises(Exception):  # noqa: B017  two writers of one version
        table._commit(2, {"batches": [], "schema": None})
    table.compact()
    assert table.read().count() == 2 and table.vacuum() == 3 and table.read().count() == 2


def test_store_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = store.add_document({"raw_content": "text", "content_type": "txt", "doc_type": "pdf"})
    assert store.add_document({"raw_content": "text", "content_type": "txt", "doc_type": "pdf"}) == one and store.read("documents").count() == 1
    assert store.document(one).first().content_type == "pdf" and store.add_document({"raw_content": "other", "content_type": "txt"}, "given") == "given"
    long = spark.createDataFrame([(1, "é" * 40_000)], "id int, text string")
    assert checked_chunks(long).select(F.octet_length("text").alias("n")).first().n == 60_000
    with pytest.raises(ValueError):
        checked_chunks(long, ("dense",))
    with pytest.raises(Exception, match="no dense"):
        checked_chunks(long.withColumn("dense", F.lit(None).cast("array<float>")), ("dense",)).collect()


def Model(fail=()):  # noqa: N802  a class of its own in each test, so that workers get it by value
    class Fake:
        calls = []

        def complete(self, prompt):
            n = prompt.count("[doc_")
            self.calls.append(n)
            if ("batch" in fail and n > 1) or ("bad" in fail and "bad" in prompt):
                raise RuntimeError("no")
            return json.dumps({f"doc_{i}": [f"fact {i}"] for i in range(n)})

    return Fake()


def test_extraction_modes():
    texts = [f"fact {i}" for i in range(5)]
    for mode, size, calls in (("auto", 5, [5]), ("auto", 2, [1] * 5), ("batch", 2, [2, 2, 1]), ("individual", 5, [1] * 5)):
        model = Model()
        assert len(ModelExtractor(model, mode, size).spans("q", texts)) == 5 and model.calls == calls
    model = Model(("batch", "bad"))
    assert ModelExtractor(model, "batch", 3).spans("q", ["one", "bad", "two"]) == [["fact 0"], [], ["fact 0"]] and model.calls == [3, 1, 1, 1]
    with pytest.raises(ValueError):
        ModelExtractor(model, "other")


def test_answer_options(spark):
    corpus = spark.createDataFrame([("a", "fact 0 of the tower stands here.", 1), ("b", "fact 1 of the tower too.", 2), ("c", "the tower.", 3)], "id string, text string, year int")
    q = spark.createDataFrame([("q", "the tower fact"), ("h", "hello there")], "id string, text string")

    class Last:
        def score(self, question, texts):
            return [float("stands" not in t) for t in texts]

    def intent(c):
        return F.when(c.startswith("hello"), F.struct(F.lit("direct").alias("route"), F.lit("'Hi!'").alias("answer"))).otherwise(F.struct(F.lit("continue").alias("route"), F.lit("").alias("answer")))

    got = {r.question_id: r for r in answer(q, corpus, filter="year < 3", extractor=ModelExtractor(Model()), reranker=Last(), intent=intent).collect()}
    assert got["h"].answer == "Hi!" and got["h"].documents == []
    assert [d.id for d in got["q"].documents] == ["b", "a"]
    near = answer(q.limit(1), corpus, k=1, extractor=lambda a, b: F.array(F.lit("FACT 0, of the towr")), verify="fuzzy").first()
    assert near.citations[0].text in corpus.where(f"id = '{near.documents[0].id}'").first().text
    pool = Strategy("contextual", citation_format="({number})")
    told = answer(q.limit(1), corpus, k=1, strategy=pool, complete=lambda p: F.lit("## T\n\n[SPAN_1]")).first().answer
    assert told.startswith("## T\n\n(1) ")


def test_structured_by_model(spark):
    corpus = spark.createDataFrame([("a", "The method is simple. The result is good.")], "id string, text string")

    class Json:
        def complete(self, prompt):
            return json.dumps({"METHOD": [{"text": "The method is simple.", "doc": 0}, "made up"], "RESULTS": ["The result is good."]})

    q = spark.createDataFrame([("q", "method result")], "id string, text string")
    r = answer_structured(q, corpus, "M [METHOD] R [RESULTS] [CITATION_REFS]", complete=completing(Json())).first()
    assert r.answer == "M [1] The method is simple. R [2] The result is good. [CITATION_REFS]"
    assert r.spans_by_document == [["The method is simple.", "The result is good."]]


def test_strategies(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    s = Strategy("pool", [])
    assert s.grow(lambda p: "A [DISPLAY_SPANS]\nno place\nA [DISPLAY_SPANS]\nB [SPAN_1]") == 2

    def fails(_):
        raise RuntimeError

    assert s.grow(fails) == 3 and s.templates[2:] == list(POOL_FALLBACKS) and s.remove(POOL_FALLBACKS[0]) and not s.remove("x")
    e = Strategy("examples", [])
    e.add("Size: [DISPLAY_SPANS]", examples=["how big is it"])
    e.add("Maker: [DISPLAY_SPANS]", examples=["who made it"])
    assert one(e.template_for(F.lit("who made this"))).startswith("Maker") and Strategy.load(e.save()) == e
    with pytest.raises(ValueError):
        e.add("X [DISPLAY_SPANS]")
    with pytest.raises(ValueError):
        Strategy("other")
    c = Strategy("contextual")
    assert "Based on the available documents" in one(c.template_for(F.lit("q"), F.array(F.lit("a")), F.lit(2), complete=lambda p: F.lit("  ")))
    s.clear()
    assert s.info()["templates"] == 0 and "[DISPLAY_SPANS]" in one(s.template_for(F.lit("q")))


def test_review_and_finalize(spark):
    corpus = spark.createDataFrame([("c", "The big tower is in Paris."), ("d", "The tower has a clock.")], "id string, text string")
    t = spark.createDataFrame([("x", "# H\n[!query=big tower in Paris]\n[!query=tower clock]\n[!query=big tower in Paris]")], "id string, text string")
    reviewed = documents.results(t, corpus, k=1)
    assert {r.query_no: r.preview for r in reviewed.collect()} == {1: "The big tower is in Paris.", 2: "The tower has a clock.", 3: "The big tower is in Paris."}
    some = reviewed.withColumn("approved", F.col("query_no") != 1).withColumn("error", F.lit(None).cast("string"))
    r = documents.finalize(t, some).first()
    assert r.text == "# H\n[!query=big tower in Paris]\n[1] The tower has a clock.\n[2] The big tower is in Paris."
    assert [d.id for d in r.documents] == ["d", "c"] and [(c.number, c.doc_index, c.highlight_index) for c in r.citations] == [(1, 0, 0), (2, 1, 0)]
    assert r.documents[0].highlights[0].start == 0
    failed = reviewed.withColumn("error", F.when(F.col("query_no") == 2, "no model"))
    assert "[Error: no model]" in documents.finalize(t, failed).first().text


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! Five six? Seven."), (2, "  "), (3, "x")], "id int, text string")
    for strategy in ("recursive", "token", "sentence", "word", "fixed", "markdown", "semantic"):
        got = chunk.chunk(docs, chunk.ChunkConfig(strategy, size=3, overlap=1)).collect()
        assert {r.document_id for r in got} == {1, 3} and all(r.text.strip() for r in got)
    assert chunk.ChunkConfig.of({"chunk_size": "9"}, "txt").recipe == "default" and chunk.ChunkConfig.of(None, "pdf").headings
    with pytest.raises(ValueError):
        chunk.ChunkConfig("odd")
    text = "# A\none\n## B\ntwo\n# C\nthree"
    parts = [(9, text.index(w), w) for w in ("one", "two", "## B", "three")]
    md = spark.createDataFrame([(9, text)], "id int, text string")
    got = {r.text: r.heading_path for r in chunk.with_heading_paths(md, spark.createDataFrame(parts, "document_id int, start int, text string")).collect()}
    assert got == {"one": ["# A"], "two": ["# A", "## B"], "## B": ["# A"], "three": ["# C"]}
    t = "| a | b |\n|---|---|\n| 1 | 2 |\n\nTable 1: after\n\nx\n\nTable 2: before\n| a | b |\n|---|---|\n\nTable 3: last\n"
    assert [t[a:b] for a, b in chunk.protected_regions(t)] == ["| a | b |\n|---|---|\n| 1 | 2 |", t[t.index("Table 2") :].rstrip("\n")]


def test_records(spark):
    rows = spark.createDataFrame([("i", "# H\nbody\n## K\nmore", "T", None, {"lang": "own"}, "en", 3)], "id string, content string, title string, source string, metadata map<string,string>, lang string, size int")
    docs = records.from_schema(rows)
    assert dict(docs.first().metadata) == {"lang": "own", "size": "3"} and docs.first().source == ""
    parts = records.pre_chunked(docs)
    last = parts.orderBy("chunk_number").collect()[-1].enhanced_text
    assert last.startswith("# H\n\n## K") and last.endswith("---\nDocument: T\nSource: Unknown\nLang: own\nSize: 3")
    held = records.attach_chunks(docs, parts.select("document_id", "chunk_number", "id", "text", "chunk_type"))
    assert records.chunks_by_type(held, "paragraph").count() == 2 and records.chunk_by_id(held, parts.first().id).count() == 1
    back = records.from_record(records.to_record(held), held.schema)
    assert back.first().chunks[0].text == "# H\nbody\n"


def test_training(spark, tmp_path):
    sample = [("q", [[("a b", True, "0a"), ("c d e", False, "0b")]], "train", "qa", "set")]
    df = spark.createDataFrame(sample, training.SAMPLE)
    training.write_samples(df, str(tmp_path / "s"))
    assert training.read_samples(spark, str(tmp_path / "s")).collect() == df.collect()
    words = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w) + 10)
    rows = training.encode_inputs(df, words, budget=8).collect()
    assert rows[0].ids == [1, 11, 2, 11, 11, 2] and [tuple(b) for b in rows[0].boundaries] == [(3, 5)] and rows[0].labels == [1]
    wide = training.padded(spark.createDataFrame([(1, [1]), (1, [1, 2, 3])], "b int, ids array<int>"), F.col("b")).collect()
    assert sorted((r.ids, r.mask) for r in wide) == [([1, 0, 0], [1, 0, 0]), ([1, 2, 3], [1, 1, 1])]
    for i, f in enumerate((0.5, 0.9, 0.9)):
        training.append_metrics(spark.createDataFrame([(i, 0.1, 0.0, 0.0, f, 0.0)], training.METRIC), str(tmp_path / "m"))
    assert training.best_epoch(spark, str(tmp_path / "m")).first().epoch == 1
    (tmp_path / "r.json").write_text(json.dumps({"id": "1", "question": "q", "documents_sentences": [[["0a", "x"], ["0b", "y"]]], "all_relevant_sentence_keys": ["0b"], "split": "validation"}) + "\n" + json.dumps({"id": "2", "question": None}))
    r = training.load_subsets(spark, {"one": str(tmp_path / "r.json")}).collect()
    assert len(r) == 1 and r[0].split == "dev" and [s.relevant for s in r[0].documents[0]] == [False, True]


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one")
    (tmp_path / "b.md").write_text("# b")
    assert readers.read_folder(spark, str(tmp_path)).count() == 1
    got = {r.title: r.raw_content for r in readers.read_folder(spark, str(tmp_path), convert=lambda b, k: b.decode()[5:]).collect()}
    assert got == {"a": "one", "b": "# b"}
    readers.append_status(spark.createDataFrame([(1,)], "id int"), str(tmp_path / "st"))
    new = spark.createDataFrame([(1,), (2,)], "id int")
    assert [r.id for r in readers.with_status(new, spark.read.json(str(tmp_path / "st"))).collect()] == [2]
    (tmp_path / "s1.json").write_text('{"id": "x", "created_at": "2024-01-02T03:04:05.123456"}')
    (tmp_path / "s2.json").write_text("{broken")
    assert readers.saved_schemas(spark, str(tmp_path / "s*.json"), "id string, created_at timestamp").first().created_at.year == 2024


def test_commands(spark, tmp_path, capsys):
    from attesta.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The big tower is in Paris. It is old.")
    main(["index", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "ix")])
    main(["template", "--output", str(tmp_path / "t.json")])
    row = main(["query", "-i", str(tmp_path / "ix"), "-q", "Where is the big tower", "-t", str(tmp_path / "t.json"), "-o", str(tmp_path / "r.json"), "-v"])
    assert "The big tower is in Paris." in row["answer"] and json.loads((tmp_path / "r.json").read_text())["citations"]


def test_finalize_many_citations(spark):
    """Time grows with the number of citations, not with its cube."""
    import time

    n = 3000
    rows = [(1, 1, [(f"s{i}", str(i)) for i in range(n)] + [("s1", "1")], [(str(i), f"a s{i} b") for i in range(n)], {}, None)]
    some = spark.createDataFrame(rows, "document_id int, query_no int, spans array<struct<text:string,doc:string>>, docs array<struct<id:string,content:string>>, params map<string,string>, error string")
    began = time.time()
    r = documents.finalize(spark.createDataFrame([(1, "[!query=a]")], "id int, text string"), some).select("documents", "citations").first()
    assert time.time() - began < 30
    assert [(c.doc_index, c.highlight_index, c.number) for c in r.citations] == [(i, 0, i + 1) for i in range(n)] + [(1, 1, n + 1)]
    assert [(d.id, len(d.highlights)) for d in r.documents] == [(str(i), 1 + (i == 1)) for i in range(n)] and tuple(r.documents[7].highlights[0]) == ("s7", 2, 4)


def test_index_of_long_texts(spark, tmp_path):
    """Words behind the stored text's limit count in every search and in the lengths; the stored text is cut."""
    index = Index(spark, str(tmp_path))
    index.add_chunks(spark.createDataFrame([(1, "filler " * 10_000 + "zebra"), (2, "short words"), (3, "more words")], "id long, text string"))
    asked = spark.createDataFrame([(1, "zebra")], "id long, text string")
    for kind in ("full_text", "sparse"):
        [hit] = index.search(asked, 5, search_type=kind).collect()
        assert hit.id == 1 and len(hit.text) == 60_000
    assert index.sizes.read().first().total == 10_005
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("taken")]
