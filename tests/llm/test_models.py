import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_field_gradient_and_marginals():
    """Forward-backward against enumeration of all labellings, for one sentence and for batches."""
    rng = np.random.default_rng(0)
    field = toxicity.Field({"a": 1, "b": 2, "c*": 3})
    field.weights, field.moves, field.start = rng.normal(size=4), rng.normal(size=(2, 2)), 0.3
    sentence = [(1,), (), (2, 3), (1, 2), ()]
    total, marginal = 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> t & 1 for t in range(5)]
        s = sum(y[t] * (field.weights[0] + sum(field.weights[i] for i in sentence[t])) for t in range(5)) + y[0] * field.start
        s += sum(field.moves[y[t], y[t + 1]] for t in range(4))
        total += np.exp(s)
        marginal += np.exp(s) * np.array(y)
    assert np.allclose(field.marginals(sentence), marginal / total)
    f = np.zeros((1, 6, 6), np.int32)
    for t, ids in enumerate(sentence):
        f[0, t, : len(ids)] = ids
    mask = np.array([[True] * 5 + [False]])
    p, _ = field._batch(np.r_[field.weights, field.moves.ravel(), field.start], f, mask)
    assert np.allclose(p[0, :5], marginal / total)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, labels).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    hit = sum(r.score >= 0.3 and r.toxic == 1 for r in held)
    assert hit >= 0.6 * sum(r.toxic for r in held) and hit >= 0.9 * sum(r.score >= 0.3 for r in held)


def test_toxicity_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.score(docs, labels).collect()} == {toxicity.score(docs, labels).first().score}
    assert toxicity.score(empty, labels).count() == 0
    some = spark.createDataFrame([(6, 1, 0), (7, None, 1), (None, 1, 1), (9, 0, 1), (20, 0, 1), (20, 0, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, some).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_spans_offsets():
    rng = random.Random(0)
    clean = [" ".join(rng.choice("on in at of by".split()) for _ in range(30)) + "." for _ in range(60)]
    toxic = [c.replace("by", "Scumbag", 3) for c in clean]
    model = toxicity.train([(t, 1) for t in toxic] + [(c, 0) for c in clean], {1: 60, 0: 60})
    text = "İ on in Scumbag at. of SCUMBAG scumbag by"
    assert [text[a:b] for a, b in model.spans(text)[0]] == ["Scumbag", "SCUMBAG scumbag"]
    assert model.score(model.spans(text)[1]) > 0.5 > model.score(model.spans("on in at")[1])


def test_toxicity_fits_all_sentences(spark):
    """Sentences beyond the first few, and words deep inside a long one, count: the field learns from a word there."""
    rng = random.Random(4)
    plain = lambda n: " ".join(rng.choice("on in at of by to".split()) for _ in range(n))
    clean = [(i, ". ".join(plain(20) for _ in range(6)) + ".") for i in range(80)]
    toxic = [(100 + i, ". ".join(plain(20) for _ in range(5)) + ". " + plain(90) + " vileword " + plain(5) + ".") for i in range(40)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert all((r.score >= 0.3) == (i >= 100) and bool(r.spans) == (i >= 100) for i, r in got.items())
    rows = [(t, int(i >= 100)) for i, t in clean + toxic if zlib.crc32(str(i).encode()) % 4 != 2]
    alone = toxicity.train(rows, {k: sum(y == k for _, y in rows) for k in (0, 1)})
    assert all(abs(alone.score(alone.spans(t)[1]) - got[i].score) < 1e-6 for i, t in clean + toxic)


def test_context_tells(spark):
    """A word that is toxic only beside another gets a larger marginal there."""
    field = toxicity.Field({"you": 1, "pig": 2})
    own = lambda text: [field.ids(w) for w in text.split()]
    rows = [(field.in_context(own("a you pig b")), [0, 0, 1, 0], 30), (field.in_context(own("a pig farm b")), [0, 0, 0, 0], 30), (field.in_context(own("a you b c")), [0, 0, 0, 0], 30)]
    field.fit(rows)
    beside, alone = field.marginals(rows[0][0])[2], field.marginals(rows[1][0])[1]
    assert beside > 0.8 and alone < 0.2


def test_quality(spark, docs, empty):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(table, labels).join(labels, "doc_id").collect()
    bad = [r for r in out if r.quality == 0]
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out) and sum(r.predicted == 0 for r in bad) >= 0.8 * len(bad)
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.classify(table, labels).where("predicted = 1").collect()}
    scores = quality.classify(docs, labels).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.classify(empty, labels).count() == 0 and quality.classify(empty, none).count() == 0


def test_quality_names_and_columns(spark):
    """Columns with clashing names pass through; metadata columns may be missing; ids and texts may have other names."""
    rows = [(i, f"word{i % 7} some text here" if i % 3 else "!!! $$$ !!! %%%", 5, i, "z") for i in range(60)]
    df = spark.createDataFrame(rows, "key long, body string, score int, _score int, words string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60, 2)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels, id_col="key", text_col="body")
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] % 3}


def test_quality_repeated_ids(spark):
    df = spark.createDataFrame([(i % 20, f"good words {i % 4} here" if i % 20 % 2 else "@@ ## @@", None, "s", 3) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 80 and all(r.predicted == r.doc_id % 2 for r in got)


def _pages(n, seed):
    """Documents of which the source tells the quality for certain, and words that tell it too, each in few documents."""
    rng, out = random.Random(seed), []
    for i in range(n):
        good = rng.random() < 0.5
        telling = rng.choice([f"{'fine' if good else 'poor'}{'abcdefghijklmnopqrst'[rng.randrange(20)]}" for _ in range(1)])
        plain = [rng.choice("the of and to in is it on at by".split()) for _ in range(20)]
        out.append((i, " ".join([*plain[:10], telling, *plain[10:]]), "en", f"{'good' if good else 'bad'}site", 100, int(good)))
    return out


def test_co_training_hands_over(spark):
    """Words that no labelled document has are learnt from documents that the metadata view is sure of."""
    rows = _pages(1500, 6)
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:60]], "doc_id long, quality int")
    from attesta.llm.common import Scratch

    scratch = Scratch(spark)
    feats = scratch.keep(quality.featured(df))

    def error(model):
        # The text view alone, on documents whose metadata it never sees.
        x = quality._evidence(feats.join(spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, label int"), "doc_id"), model)
        return np.mean((model.scores(x[0])[0] >= 0.5) != x[1])

    alone, co = quality.fit(feats, labels, scratch, rounds=0), quality.fit(feats, labels, scratch)
    assert error(co) <= 0.5 * error(alone) and error(co) < 0.05
    assert co.handed[0][0] > 1000 and not alone.handed
    # More documents, more that is handed over.
    few = quality.fit(scratch.keep(feats.where("doc_id < 500")), labels, scratch)
    assert few.handed[0][0] < 0.5 * co.handed[0][0]


def test_features_against_plain_counts():
    """Evidence and counts of a batch against loops over its lists."""
    import pyarrow as pa

    rng, ints = random.Random(2), pa.list_(pa.int32())
    featurer = quality.Featurer()
    texts = [None, "", "THE!! OLD!!", "a b a b", " ".join(rng.choice(["one", "Two", "3", "x|y"]) for _ in range(50))]
    columns = [list(c) for c in zip(*map(featurer.text, texts), strict=True)]
    meta = [quality.metadata_places({"lang": x, "n_chars": n}) for x, n in zip(["en", None, "de", "en", "fr"], [1, None, 1000, float("nan"), 7], strict=True)]
    f = quality.Features(*(pa.array(c, ints) for c in (*columns, meta)))
    model = quality.CoTrained(np.arange(quality._SIZE) / 1000.0, [], np.zeros(3))
    for i, row in enumerate(model.evidence(f)):
        words, shapes, shares = (c[i] for c in columns)
        want = [1, sum(w / 1000 for w in words) / max(1, len(words)), sum(p * s for p, s in zip(shapes, shares, strict=True)) / 1e6, sum(p / 1000 for p in meta[i])]
        assert np.allclose(row, want)
    counts = np.zeros((2, quality._SIZE), np.int64)
    f.count(counts, 0, np.array([1, -1, 0, 1, -1]))
    f.count(counts, 1, np.array([0, 0, -1, 1, 1]))
    plain = np.zeros_like(counts)
    for i, k in ((0, 1), (2, 0), (3, 1)):
        for w in columns[0][i]:
            plain[k, w] += 1
        for p, s in zip(columns[1][i], columns[2][i], strict=True):
            plain[k, p] += s
    for i, k in ((0, 0), (1, 0), (3, 1), (4, 1)):
        for p in meta[i]:
            plain[k, p] += 1
    assert (counts == plain).all()
    assert quality.shape("THERE!!") == "X!" and quality.shape("don't") == "x'x"
