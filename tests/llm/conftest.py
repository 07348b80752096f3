import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, h string, th long, fp string, row string, label int, kept boolean, hits string, item_id long, score double"


def make_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, ties, odd white space."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "the", "re", "ou", "ti", "éa", "st", "b", "ing"]) for _ in range(rng.randrange(1, 5)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    shared = [line() for _ in range(6)]
    long = "\n".join(line(40) for _ in range(120))
    rows = [(1, None), (2, ""), (3, ""), (4, "\n\n"), (5, "   \t\x0b"), (None, "a null id"), (None, "a null id"), (6, long), (7, long), (8, long + " end"), (9, "Short"), (10, "short")]
    rows += [(20 + i, "\n".join([shared[i % 6], "  " + shared[(i + 1) % 6].upper() + "\t", line(), line(30)])) for i in range(12)]
    rows += [(40 + i, "one two three four five six seven eight nine ten " + line(2)) for i in range(4)]
    rows += [(50, "x " * 50), (51, "x " * 50), (50, "x " * 50), (60, "e.mail@a.b.c é ☃ +1 (234) 555-7890 4111 1111 1111 1111 1.2.3.4 999.1.1.1"), (61, 'token = "abc123def" AKIA' + "Z9" * 10 + " deadbeef" * 4)]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None if k % 4 == 0 else len(t or ""), "d", 3, "h", 1, "f", "r", 1, True, "hit", 5, 0.5) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
