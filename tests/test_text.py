from pyspark.sql import functions as F

from attesta.functions import templates, text


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first().x


def test_sentences_and_tokens(spark):
    assert one(spark, text.sentences(F.col("t")), t="One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, text.sentences(F.col("t")), t="   ") == []
    assert one(spark, text.tokens(F.col("t")), t="Été, a_b 12!") == ["été", "a_b", "12"]


def test_clean_answer(spark):
    for given, want in (('"Hello world"', "Hello world"), ("'Hello world'", "Hello world"), ("line1\\nline2", "line1\nline2"), ("a   b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("", "")):
        assert one(spark, text.clean_answer(F.col("t")), t=given) == want


def test_is_table(spark):
    assert one(spark, text.is_table(F.col("t")), t="| a | b |\n|---|---|\n| 1 | 2 |")
    assert not one(spark, text.is_table(F.col("t")), t="A sentence.")
    assert not one(spark, text.is_table(F.col("t")), t="one | line")


def test_trim_punctuation(spark):
    assert one(spark, text.trim_punctuation(F.col("t")), t=" .,– a, b!? ") == "a, b"


def test_byte_truncate(spark):
    for t in ("abc", "é" * 10, "日本語" * 5, "a😀b😀", "", "x" * 30):
        for limit in range(1, 20):
            assert one(spark, text.byte_truncate(F.col("t"), limit), t=t) == t.encode()[:limit].decode(errors="ignore")


def test_content_type(spark):
    for source, want in (("a/b.PDF", "pdf"), ("https://x.org/page", "web_page"), ("https://x.org/a.md?q=1.z", "markdown"), ("notes", "unknown"), ("x.htm", "html")):
        assert one(spark, text.content_type(F.col("t")), t=source) == want


def test_occurrences(spark):
    assert one(spark, text.occurrence_starts(F.col("t"), F.col("s")), t="aXaXXa", s="X") == [1, 3, 4]
    assert one(spark, text.occurrence_starts(F.col("t"), F.col("s")), t="aaaa", s="aa") == [0, 2]
    assert one(spark, text.occurrence_starts(F.col("t"), F.col("s")), t="a.b*c\\Ed", s="\\E") == [5]
    assert one(spark, text.occurrence_starts(F.col("t"), F.col("s")), t="abc", s="") == []


def test_windows(spark):
    got = one(spark, text.fixed_windows(F.col("t"), 4, 1), t="abcdefgh")
    assert [(r.start, r.text) for r in got] == [(0, "abcd"), (3, "defg"), (6, "gh")]
    assert len(one(spark, text.fixed_windows(F.col("t"), 4, 4), t="abcdefgh")) == 1


def fill(spark, template, spans, cited=None, style="inline"):
    arr = F.array(*map(F.lit, spans)).cast("array<string>")
    extra = None if cited is None else F.array(*map(F.lit, cited)).cast("array<string>")
    return spark.range(1).select(templates.fill(F.lit(template), arr, extra, style).alias("x")).first().x


def test_fill(spark):
    assert fill(spark, "[DISPLAY_SPANS]", ["Span one.", "Span two."]) == "[1] Span one.\n\n[2] Span two."
    assert fill(spark, "[FACT_1] [FACT_2]", ["Alpha.", "Beta."]) == "[1] Alpha. [2] Beta."
    assert fill(spark, "[DISPLAY_SPANS] Refs: [CITATION_REFS]", ["a"], ["b"]) == "[1] a Refs: [2]"
    assert fill(spark, "[DISPLAY_SPANS]", ["a"], style="hidden") == "a"
    assert "No relevant information" in fill(spark, "A [DISPLAY_SPANS]", []) and fill(spark, "", []) == ""


def test_placeholders_and_links(spark):
    assert "[DISPLAY_SPANS]" in one(spark, templates.ensure_placeholder(F.col("t")), t="plain")
    assert one(spark, templates.ensure_placeholder(F.col("t")), t="[FACT_1]") == "[FACT_1]"
    assert one(spark, templates.placeholders(F.col("t")), t="[METHOD] [DISPLAY_SPANS] [FACT_2]") == ["METHOD"]
    numbers = F.create_map(F.lit("v1"), F.lit(2), F.lit("v3"), F.lit(4))
    got = spark.range(1).select(templates.linked_numbers(F.array(F.lit("v1"), F.lit("x"), F.lit("v3")), numbers).alias("x")).first().x
    assert got == "[2] [4]"


def test_strategy(spark):
    s = templates.Strategy("pool", ["A [DISPLAY_SPANS]", "B [DISPLAY_SPANS]"])
    s.validate()
    assert templates.Strategy.load(s.save()) == s
    rows = spark.range(20).select(F.col("id").cast("string").alias("q")).select("q", s.template_for(F.col("q")).alias("t")).collect()
    assert {r.t[0] for r in rows} == {"A", "B"}
    assert templates.render("Ask {{ q }}!", {"q": "why"}) == "Ask why!"
