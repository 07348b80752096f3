import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, decontaminate, license_scan, pii, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_license(spark, docs, empty):
    df = spark.createDataFrame([(1, "Intro.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "We say: released under the MIT license."), (3, None), (4, ""), (5, "word"), (6, "of the in the of the"), (7, "x. Released under the MIT License. Licensed under the MIT License.")], "doc_id int, text string")
    got = {(r.doc_id, r.license_id, r.n_units) for r in license_scan.scan(df).collect()}
    assert got == {(1, "Apache-2.0", 2), (2, "MIT", 1), (7, "MIT", 2)}
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0


def test_whole_licences(spark, tmp_path):
    """Short licences are found by their whole text in any lay-out; others by the texts of a folder."""
    import os
    import textwrap

    for name, text in license_scan.TEMPLATES[:5]:
        body = f"Copyright (c) 2020 Some One\n\n{textwrap.fill(text, 70)}\n"
        got = {r.license_id: r.dice for r in license_scan.scan(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()}
        assert got[name] > 0.9
    long = " ".join(f"term{i} of clause{i * 7 % 300}" for i in range(2000))
    (tmp_path / "Made-Up-1.0.txt").write_text(long)
    templates = license_scan.read_templates(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, textwrap.fill(long, 80)), (2, long[: len(long) // 4]), (3, "x " + long.replace("term5", "word5"))], "doc_id long, text string")
    assert {(r.doc_id, r.license_id) for r in license_scan.scan(docs, templates).collect()} == {(1, "Made-Up-1.0"), (3, "Made-Up-1.0")}
    folder = "/usr/share/common-licenses"
    if os.path.exists(f"{folder}/Apache-2.0"):
        whole = [(n, open(f"{folder}/{n}", encoding="utf-8").read()) for n in ("Apache-2.0", "GPL-3") if os.path.exists(f"{folder}/{n}")]
        df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(whole)], "doc_id long, text string")
        assert {(r.doc_id, r.license_id) for r in license_scan.scan(df, whole).collect()} >= {(i, n) for i, (n, _) in enumerate(whole)}


def test_license_bounds():
    for size in range(1, 40):
        allowed = set(license_scan.size_bounds(size))
        for other in range(1, 80):
            best = 2 * min(size, other) / (size + other)
            assert (other in allowed) == (best >= 0.8 - 1e-9)


def cut(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("pass_rows", [400_000, 150])
def test_decontaminate(spark, docs, rows, pass_rows):
    rng = random.Random(5)
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(t.split()[3 : 3 + rng.randrange(8, 26)])) for i, t in enumerate(texts)]
    items += [(100, None), (101, "too short"), (102, "not in any of the documents at all I hope"), (103, "one two three four five six seven eight CHANGED ten"), (104, "One, two; three four five six seven eight nine ten")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, *_ in rows:
        for j, s in items:
            q = cut(s)
            if q and len(q & cut(t)) >= 0.8 * len(q):
                want.add((i, j, len(q), len(q & cut(t))))
    got = decontaminate.contained_items(docs, table, pass_rows=pass_rows).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == want and len(got) == len({(r.doc_id, r.th, r.item_id) for r in got})
    if pass_rows > 1000:
        kept = decontaminate.drop_contaminated(docs, table)
        assert kept.columns == docs.columns
        bad = {i for i, *_ in want}
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in bad)


def test_decontaminate_scattered(spark):
    """An item in two far parts of a long document, in enough documents that a weak search would miss some."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, [word() for _ in range(rng.randrange(12, 60))]) for i in range(60)]
    docs = []
    for i, w in items:
        noise = [[word() for _ in range(300)] for _ in range(3)]
        half = len(w) // 2
        docs.append((i, " ".join(noise[0] + w + noise[1])))
        docs.append((1000 + i, " ".join(noise[0] + w[:half] + noise[1] + w[half - 4 :] + noise[2])))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for i, _ in items for d in (i, 1000 + i)}


def test_decontaminate_empty(spark, docs, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs, items).count() == 0
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == docs.count()


def texts_for_bpe(rows):
    rng = random.Random(2)
    extra = ["<|endoftext|>a <|startoftext|>b", "ΑΣ ΑΣ", "é é", "a" * 400, "İstanbul ǅ ß ½²", "a\x1cb\x85c​d", "don't we're I'M"]
    extra += ["".join(rng.choice("aab'éèst xyΣς\n日本<|>123!.") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in enumerate(extra)]


def test_bpe(spark, rows, empty):
    library, data = Tokenizer.from_file(PATH), texts_for_bpe(rows)
    want = Counter()
    for i, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))] += 1
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(map(tuple, bpe.round_trip_digests(df, PATH).collect())) == want
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert Counter((r.doc_id, sha(r.text)) for r in back.collect()) == Counter((i, d) for i, _, _, d in want.elements())
    assert bpe.encode(empty, PATH).count() == 0


def test_automaton_against_merging():
    rng = random.Random(4)
    letters = "abc"
    for _ in range(60):
        vocab = {c: i for i, c in enumerate(letters)} | {c + "$": i + 3 for i, c in enumerate(letters)}
        merges = []
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice([v for v in vocab if not v.endswith("$")]), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
        machine, rank = bpe.Automaton(vocab, merges, "$", {}), {tuple(m): k for k, m in enumerate(merges)}
        for _ in range(80):
            w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
            parts = [*w[:-1], w[-1] + "$"]
            while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert machine.word(w) == [vocab[p] for p in parts]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def pii_brute(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end(), "card")] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def secrets_brute(t):
    either = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


@pytest.mark.parametrize("module,brute", [(pii, pii_brute), (secrets, secrets_brute)])
def test_spans(docs, rows, empty, module, brute):
    want = Counter((r[0], sha(brute(r[1] or ""))) for r in rows)
    got = module.scan(docs).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert set(brute(next(r[1] for r in rows if r[0] == 60)).split(",")) <= set(by[60].spans.split(","))
    assert module.scan(empty).count() == 0


def test_spans_fuzz():
    rng = random.Random(9)
    for _ in range(4000):
        t = "".join(rng.choice("a1@.+-() 9%Ab4532") for _ in range(rng.randrange(70)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(pii.entities(t), key=lambda s: (s[0], pii.KINDS.index(s[2])))) == pii_brute(t)
        t = "".join(rng.choice(["token", "Secret", "api_key", "=", ":", " ", "'", "a", "f", "0", "AKIA", "Z", "deadbeef", "ſecret", "."]) for _ in range(rng.randrange(40)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(secrets.base_spans(t), key=lambda s: (s[0], secrets.KINDS.index(s[2])))) == secrets_brute(t)


def test_disclosing_terms(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ra re ri ro ru ta te ti to tu".split())
    rows = [(i, " ".join(word() for _ in range(20)) + (f" contactme u{i}@x.org " if i % 5 == 0 else " ") + " ".join(word() for _ in range(20))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = pii.disclosing_terms(df)
    assert {t for _, t in terms} == {"contactme"}
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("@" not in t and "contactme" not in t for t in got.values()) and "[EMAIL]" in got[0]
    assert all(("term:" in r.spans) == (r.doc_id % 5 == 0) for r in pii.scan(df).collect())


def test_support_counts_documents(spark):
    """A word that one document repeats beside an address has no support; that of five documents has."""
    rows = [(0, "lonelyword u@x.org " * 20)] + [(i, f"sharedword u{i}@x.org " + "ra re ri ro ru ta te ti to tu " * 4) for i in range(1, 6)]
    rows += [(i, "ra re ri ro ru ta te ti to tu " * 8) for i in range(6, 60)]
    terms = pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {t for _, t in terms} == {"sharedword"}


@pytest.mark.parametrize("few", [100_000, 0])
def test_support_does_not_grow(spark, few):
    """A term beside six of 1200 addresses has its spans, whether terms are sent to the tasks or joined."""
    rows = [(i, "ra re ri ro ru ta te ti to tu " * 6 + (f"only{i // 6} " if i < 60 else "") + f"u{i}@x.org " + "la le li lo lu " * 6) for i in range(1200)] + [(3, None), (None, "only1 u@x.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.scan(df, few=few).collect()
    assert len(got) == len(rows)
    assert all(("term:" in r.spans) == (r.doc_id is None or r.doc_id < 60 and r.n_email == 1) for r in got)


def test_ordinary_words_of_all_rows(spark):
    rows = [(None if i % 2 else i, "wordone wordtwo, wordone " + "x" * (i % 5) + "é.") for i in range(1000)]
    rows[7] = (7, rows[7][1] + " secret = abc999 " + "a1" * 12)
    found = secrets.learnt(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {int(r.key): r.n for r in found if r.kind == "pair"}
    assert {r.key for r in found if r.kind == "value"} == {"abc999", "a1" * 12}
    want, names = Counter(), " " + secrets._LETTERS
    for i, (_, t) in enumerate(rows):
        t = f" {t.split(' secret')[0] if i == 7 else t} "
        places = [max(0, names.find(c)) for c in t]
        want.update(a * len(names) + b for a, b in zip(places, places[1:], strict=False) if a or b)
    assert got == want
    scorer = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(2 ** scorer.bits["w" + c] for c in names) == pytest.approx(1) and scorer.bits["wo"] > -0.1


def test_grammar():
    rng = random.Random(3)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    words = ["".join(rng.choice("aeinstrhod") for _ in range(rng.randrange(4, 14))) for _ in range(300)]
    scorer = secrets.Scorer(values, secrets.pairs_of(" ".join(words)))
    assert len(scorer.grammar.next) < sum(map(len, values)) / 20
    fresh = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    text = f"see ..{fresh}.. and antidisestablishment99arians here."
    found, scored, most = scorer.scan(text, [])
    assert [text[a:b] for a, b, _ in found] == [fresh] and scored == 1 and most == scorer.odds(fresh)[0] > secrets.MARGIN
    at = text.index(fresh)
    assert scorer.scan(text, [(at, at + 32, "hex")])[0] == [] and scorer.scan(text, [(at, at + 32, "hex")])[1:] == (scored, most)
    assert secrets.Scorer([], secrets.pairs_of("")).scan(text, [])[:2] == ([], 0)


def test_formats_without_a_pattern(spark):
    """Credentials that stand without an assignment are found by their format alone, short ones too; words are not."""
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    def word():
        w = "".join(rng.choice(["an", "the", "re", "ou", "ti", "st", "b", "ing", "er", "qu", "fy", "x", "vo", "lk", "mp", "z", "dg", "j"]) for _ in range(rng.randrange(1, 6)))
        return rng.choice([w, w, w, w, w.title(), w.title(), w.upper(), str(rng.randrange(1, 10 ** rng.randrange(1, 9)))])

    prose = lambda: " ".join(word() for _ in range(300))
    rows = [(i, f"{prose()} {'secret' if i % 2 else 'api_key'} = '{'ghp_' + key(36) if i % 2 else key(12)}' {prose()}") for i in range(300)]
    rows += [(1000 + i, f"{prose()} {'ghp_' + key(36) if i % 2 else key(12)} {prose()}") for i in range(20)]
    rows += [(2000 + i, prose()) for i in range(200)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r.doc_id for r in got if "format:" in r.spans}
    assert len(hit & set(range(1000, 1020))) >= 18 and not hit - set(range(1000, 1020))
    assert all(r.n_scored > 0 and r.n_format == r.spans.count("format:") for r in got)
    assert all(r.most_bits >= secrets.MARGIN for r in got if r.doc_id in hit)
