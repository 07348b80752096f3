import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import exact_dedup, line_dedup, simhash


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    kept = Counter()
    by_sha = {sha(t): (t, ids) for t, ids in groups.items()}
    for r in got:
        t, ids = by_sha[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[t] += r.kept
    assert set(kept.values()) == {1}


def test_exact_drop_clashing_names(spark):
    rows = [(1, "a", "x", 5), (2, "a", "y", 6), (2, "a", "y", 6), (3, "b", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, number int")
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(2, "a", "y", 6), (3, "b", "z", 7)]


def test_exact_drop(docs, rows):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r.text or "" for r in got) == Counter({r[1] or "" for r in rows})
    assert all(r.doc_id == max((x[0] for x in rows if (x[1] or "") == (r.text or "") and x[0] is not None), default=None) for r in got)


@pytest.mark.parametrize("support", [1e-4, 0.05, 0.9])
def test_hot_digests(spark, support):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(F.col("id").cast("string")).alias("text"))
    got = {(r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df, support=support).where("group_size > 1").collect()}
    assert got == {(2997, 1000), (2951, 40)}


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.keep_one_of_each(empty).count() == 0


def line_brute(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for s in (t or "").split("\n"):
                if len(key(s)) >= 10:
                    held[key(s)].add(i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [s for s in lines if i is None or len(held[key(s)]) < 2 or min(held[key(s)]) == i]
        out[i, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(docs, rows, batches):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, batches=batches).collect())
    assert got == line_brute(rows)


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(spark, 4, fanout=2)
    for b in range(5):
        keys = spark.createDataFrame([(bytes([k]), 10 * b, 10 * b, 1) for k in range(b, b + 3)], "h binary, first long, last long, n long")
        runs.add(keys)
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    owners = {r.h: r.owner for level in runs.levels for t in level for r in runs._fresh(t).collect()}
    assert owners == {bytes(bytearray([k])): 10 * max(0, k - 2) for k in range(7)}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("attesta_run_")]


def test_line_index_is_kept_by_name(spark, docs):
    """A named index outlives the call; one without a name leaves no table."""
    before = {t.name for t in spark.catalog.listTables()}
    line_dedup.dedup_lines(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    a = spark.createDataFrame([(5, "a line that repeats\nonly here in five"), (6, "A line that repeats")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a line that repeats\nfirst seen in one"), (9, "first seen in one")], "doc_id long, text string")
    name = "kept_by_name"
    one = {r.doc_id: r.text for r in line_dedup.dedup_lines(a, batches=2, index=name).collect()}
    two = {r.doc_id: r.text for r in line_dedup.dedup_lines(b, batches=2, index=name).collect()}
    again = {r.doc_id: r.text for r in line_dedup.dedup_lines(a, batches=2, index=name).collect()}
    assert one == again == {5: "a line that repeats\nonly here in five", 6: ""}
    assert two == {1: "first seen in one", 9: ""}
    for t in spark.catalog.listTables():
        if name in t.name:
            spark.sql(f"DROP TABLE {t.name}")


def fingerprint_brute(t, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components_brute(prints):
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ps = list(up)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    return {p: find(p) for p in ps}


@pytest.mark.parametrize("words,shard_rows", [(3, 100_000), (5, 0)])
def test_near_groups(docs, rows, words, shard_rows):
    prints = [fingerprint_brute(r[1], words) for r in rows]
    root, least = components_brute(prints), {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    want = Counter((r[0], p, least.get(root[p])) for r, p in zip(rows, prints, strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs, words=words, shard_rows=shard_rows).collect())
    assert got == want
    if shard_rows:
        keep = simhash.keep_one_of_each(docs, groups=lambda d, **o: simhash.near_groups(d, words=words, shard_rows=0, **o))
        assert keep.columns == docs.columns
        assert sorted(str(r.doc_id) for r in keep.collect()) == sorted(str(i) for i, p, c in want.elements() if i is None or i == c)


def test_forest_and_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = lambda b: b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, *(flips(b) for b in base)]))
    root = components_brute([int(x) for x in fps])
    for visits in (200, 2_000_000):
        u, v = simhash.Forest(np.zeros(len(fps), np.int64), fps).stars(visits=visits)
        star = dict(zip(u.ravel().tolist(), v.ravel().tolist(), strict=True))
        groups = lambda m: {frozenset(x for x in root if m(x) == r) for r in {m(x) for x in root}}
        assert groups(lambda x: star.get(x, x)) == groups(root.get)
    links = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    for shard_rows in (0, 10**9):
        held = defaultdict(set)
        for r in simhash.shards(df, shard_rows).collect():
            held[r.shard].add(r.fp % (1 << 64))
        assert all(any(a in s and b in s for s in held.values()) for a, b in links)


def test_wide_groups(spark, docs, rows, empty):
    """Near copies by changed words meet, other texts do not; copies and blank texts are groups."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("aeinrst"), 6)) for _ in range(400)]
    data = []
    for g in range(60):
        words = list(rng.choice(vocabulary, 150))
        data.append((g * 10, " ".join(words)))
        for k in range(1, 4):
            changed = list(words)
            for at in rng.choice(150, k, replace=False):
                changed[at] = "changed"
            data.append((g * 10 + k, " ".join(changed)))
    got = {r.doc_id: r.component_id for r in simhash.wide_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(c // 10 == d // 10 for d, c in got.items())
    assert sum(c == d // 10 * 10 for d, c in got.items()) >= 0.97 * len(data)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 6, 9, None}
    assert {6, 1} == {r.component_id for r in simhash.wide_groups(docs).where("doc_id in (3, 4, 5, 7, 8)").collect()}
    assert simhash.wide_groups(empty).count() == 0


def test_wide_links_are_of_similar_texts(spark):
    """Groups are the components of the pairs of index 0.8 or more: a shared passage links nothing, and no pair is missed."""
    rng = np.random.default_rng(9)
    passage, texts = [f"p{k}" for k in range(150)], []
    texts += [passage + [f"d{g}w{k}" for k in range(50)] for g in range(150)]
    for g in range(40):
        words = [f"g{g}w{k}" for k in range(60 + g)]
        texts.append(words)
        for k in range(1, 6):
            at = set(rng.choice(len(words), k, replace=False).tolist())
            texts.append([f"c{g}n{k}" if i in at else w for i, w in enumerate(words)])
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    up = list(range(len(texts)))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for radius in (0, simhash.WIDE_RADIUS):  # with a radius of 0 the prefix filter finds all links
        got = {r.doc_id: r.component_id for r in simhash.wide_groups(df, radius=radius).collect()}
        assert got == dict(enumerate(up))


def test_dense_group_without_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (1, 2), dtype=np.uint64)
    near = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64)), axis=0)
    far = rng.integers(0, 2**63, (200, 2), dtype=np.uint64)
    fps = np.concatenate([far[:100], near, far[100:]])
    label = simhash.Forest(np.zeros(len(fps), np.int64), fps, 24).groups(visits=5000)
    assert len(set(label[100 : 100 + len(near)])) == 1 and len(set(label)) == 201


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    from attesta.llm.common import Scratch

    got = {r.u: r.root for r in simhash.components(edges, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


@pytest.mark.parametrize("n", [1, 4])
def test_near_groups_of_few_documents(spark, n):
    """More shuffle partitions than rows: tasks without rows give nothing."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(words + [str(i)] * (i > 2))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for groups in (simhash.near_groups, simhash.wide_groups):
            got = {r.doc_id: r.component_id for r in groups(df).collect()}
            assert set(got) == set(range(n)) and all(got[i] == 0 for i in range(min(n, 3)))
        assert simhash.keep_one_of_each(df.where("doc_id < 2")).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_components_of_a_hub(spark):
    """A star, a chain, a cycle and a lone edge, against a union-find."""
    from attesta.llm.common import Scratch

    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(5, 5), (3001, 3000), (3000, 3001)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {(x, find(x)) for x in up if find(x) != x}
    got = simhash.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    assert {(r.u, r.root) for r in got} == want and len(got) == len(want)


def test_word_hashes(rows):
    """Equal words have equal hashes wherever they stand, other words others, across the cuts of a long text too."""
    hasher = simhash.WordHasher()
    hasher.CHUNK = 50
    known = {}
    for r in rows:
        text = (r[1] or "").encode()
        words, hashes = text.lower().split(), hasher(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 1000


def test_wide_shingles(rows):
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        got = simhash.wide_shingles((r[1] or "").encode())
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()


def jaccard_pairs(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    both = Counter((a, b) for ids in owners.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    return {(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}


def test_wide_groups_on_the_table(spark):
    """All texts of the table: exactly the components of all pairs at 0.8, none lost, none without a partner."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in jaccard_pairs([t for _, t in rows]):
        a, b = sorted((find(rows[a][0]), find(rows[b][0])))
        up[b] = a
    got = {r.doc_id: r.component_id for r in simhash.wide_groups(table).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_tokens_of_many_texts(spark, monkeypatch):
    """Pairs are the same whether a token's texts are few or many."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 50, 60)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(0, 7)), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.wide_groups(df).collect()}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in jaccard_pairs([t for _, t in rows]):
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert want == {i: find(i) for i, _ in rows}
    assert len(set(want.values())) > 1


def test_links_of_a_dense_group(spark, monkeypatch):
    """A large group of near copies is joined by few links, not by all its pairs; the groups are those of all pairs."""
    rng, texts = np.random.default_rng(4), []
    base = [f"w{i}" for i in range(300)]
    for i in range(200):
        w = list(base)
        for k in rng.choice(300, int(rng.integers(0, 6)), replace=False):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    up = list(range(200))
    pairs = jaccard_pairs(texts)
    for a, b in pairs:
        up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    verified, held = simhash._verified, []
    monkeypatch.setattr(simhash, "_verified", lambda links, *args: held.append(links.count()) or verified(links, *args))
    monkeypatch.setattr(simhash, "CARRIED", 1000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # With a radius of 0 the prefix filter finds all links.
    assert {r.doc_id: r.component_id for r in simhash.wide_groups(df, radius=0).collect()} == dict(enumerate(up))
    assert len(pairs) > 10_000 and sum(held) < 2000


@pytest.mark.parametrize("many", [40, 700])
def test_forest_of_pairs(many):
    """Forests of a token have an edge less than ids in each connected part of all its pairs, also if pairs come in pieces."""
    rng = np.random.default_rng(many)
    group = rng.integers(0, many, many)
    size = rng.integers(90, 130, many)
    bits = np.zeros((many, 16), np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (many, 16), dtype=np.uint64)) * (rng.random((many, 16)) < 0.7)
    first = np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]]
    found = []
    for whole in (True, False):
        a, b = (np.concatenate(x) for x in zip(*simhash._pairs_of_many(group, size, bits, whole), strict=True))
        found.append((a, b, simhash._connected(first.copy(), a, b)))
    (a, b, label), (u, v, same) = found
    brute = {(i, j) for i in range(many) for j in range(i) if group[i] != group[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and 9 * np.bitwise_count(bits[i] ^ bits[j]).sum() <= size[i] + size[j]}
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == brute and len(a) == len(brute)
    assert np.array_equal(label, same) and len(u) == len(set(first)) - len(set(label)) < len(a)


def test_parities_of_long_sets():
    """1024 parities are all alike for two sets of 3000; as many as the sets need tell them apart, and lose no pair at 0.8."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 64, 40_000, np.uint64, endpoint=False))
    apart = h[:3000], np.sort(np.r_[h[:1500], h[5000:6500]])
    assert not simhash._long_match(*map(simhash._long_parity, apart), 6000)
    for n in (513, 1023, 1025, 3000, 16_500):
        for m in (math.ceil(0.8 * n), n):
            shared = math.ceil((n + m) * 4 / 9)
            a, b = np.sort(h[:n]), np.sort(np.r_[h[:shared], h[20_000 : 20_000 + m - shared]])
            maps = simhash._long_parity(a), simhash._long_parity(b)
            assert None in maps or (simhash._long_match(*maps, n + m) and simhash._long_match(*maps[::-1], n + m))
    assert simhash._long_parity(h[:512]) is None


def test_links_in_parts(spark, monkeypatch):
    """However little may be carried at a time, the same documents are linked."""
    rng, texts = np.random.default_rng(5), []
    for _ in range(4):
        words = [f"w{x}" for x in rng.integers(0, 9999, 700)]
        texts += [" ".join(words[:at] + [f"x{at}"] + words[at + 1 :]) for at in (10, 300, 600)]
    table, parts, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), simhash._parts, []
    monkeypatch.setattr(simhash, "_parts", lambda *args: made.append(parts(*args)) or made[-1])
    monkeypatch.setattr(simhash, "CARRIED", 0.6)
    assert {r.doc_id: r.component_id for r in simhash.wide_groups(table).collect()} == {i: i // 3 * 3 for i in range(12)}
    assert max(map(len, made)) > 1


def test_scratch_leaves_no_shuffle_files(spark):
    from pathlib import Path

    from attesta.llm.common import Scratch

    def files():
        base = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
        return {p for p in base.rglob("shuffle_*.data")}

    before = files()
    kept = Scratch(spark).keep(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count())
    assert kept.count() == 97
    for _ in range(20):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert len(left) <= 1, left  # that of the count


def test_lean_workers(spark, monkeypatch):
    """Workers are left without free memory by every task of the pipeline's Python operators."""
    from attesta.llm import common

    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append(1))
    assert list(common.lean(lambda batches: iter(list(batches)))(iter("ab"))) == ["a", "b"] and said == [1]
