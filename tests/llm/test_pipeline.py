import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import jaccard_pairs
from test_text_scans import cut
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from attesta.llm import quality, queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def smallest_of_each(ids, texts):
    """The smallest id of each component of texts with a Jaccard index of 0.8 or more, by all pairs."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in jaccard_pairs(texts):
        a, b = sorted((find(ids[a]), find(ids[b])))
        up[b] = a
    return {i for i in ids if find(i) == i}


def test_stages(spark):
    """Each stage against a plain version of its rule; columns stay; the last encodes what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_before = docs
        docs = stage(spark, docs, SF)
        after = docs.toPandas()
        assert docs.columns == columns and set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0.6 * len(before)
        if name == "quality classifier":
            scored = quality.classify(docs_before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after["doc_id"]) == {r.doc_id for r in scored.where("predicted = 1").collect()}
        if name == "exact dedup":
            assert sorted(after["doc_id"]) == sorted(before.groupby("text")["doc_id"].max())
        if name == "simhash near-dedup":
            assert set(after["doc_id"]) == smallest_of_each(list(before["doc_id"]), list(before["text"]))
        if name == "benchmark decontamination":
            items = [cut(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]]
            leaks = {i for i, t in zip(before["doc_id"], before["text"], strict=True) for q in items if q and len(q & cut(t)) >= 0.8 * len(q)}
            assert set(after["doc_id"]) == set(before["doc_id"]) - leaks
        docs, before = spark.createDataFrame(after), after
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in zip(before["doc_id"], before["text"], strict=True)}
    assert sorted(got) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "The Cat sat, twice."), (2, None), (3, "ré ß 12")], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.bpe_stage(spark, docs, SF).collect():
        text = " ".join(map(library.id_to_token, r.ids))
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, data: sorted(repr([round(r[columns.index(c)], 6) if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in order]) for r in data)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_long_text(spark):
    """One text far longer than the rest goes through every query's operator whole."""
    rng = np.random.default_rng(0)
    words = np.array(["the", "and", "ing", "tion", "ou", "ré", "ß"])
    long = " ".join(words[rng.integers(0, len(words), 60_000)])
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, "y")], "doc_id long, text string")
    from attesta.llm import bpe, decontaminate, exact_dedup, license_scan, line_dedup, pii, secrets, simhash, toxicity

    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_groups(df).where("kept").count() == 3 and quality.classify(df, labels).count() == 3
    assert toxicity.score(df, labels).count() == 3
    assert pii.scan(df).where("n_spans = 0").count() == 3 and secrets.scan(df).where("n_format = 0").count() == 3
    assert simhash.near_groups(df).where("component_id = 1").count() == 2
    assert line_dedup.dedup_lines(df).agg(F.sum(F.length("text"))).first()[0] == 2 * len(long) + 3
    item = spark.createDataFrame([(9, " ".join(long.split()[40_000:40_030]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contained_items(df, item).collect()} == {1, 2}
    assert license_scan.scan(df).count() == 0
    assert bpe.encode(df, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 1").first().n_tokens >= 60_000
