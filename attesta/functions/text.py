"""Text as columns: sentences, tokens, windows, clean-up, tests. All built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.schema import CONTENT_TYPES

WORDS = r"[\p{L}\p{N}_]+"

#: The characters that are white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where sentences end, and what is trimmed off a span.
SENTENCE_END, PUNCTUATION = rf"(?<=[.!?])[{WHITE}]+", r"[\s.,;:!?\-–—]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column) -> Column:
    """Split behind ``.``, ``!`` or ``?`` and white space; stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)


def fixed_windows(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of (start, text) windows of ``size`` characters, trimmed; a single one where the overlap leaves no stride."""
    stride = size - overlap
    last = F.greatest(F.length(text) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(stride)) if stride > 0 else F.array(F.lit(0))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), strip(F.substring(text, s + 1, F.lit(size))).alias("text")))


def word_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Runs of ``size`` space-separated words, joined again."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.array_join(F.slice(parts, s + 1, F.lit(size)), " "))


def clean_answer(text: Column) -> Column:
    """One pair of outer quotes off, escaped newlines real, runs of blanks one, three or more newlines two, trimmed."""
    text = F.regexp_replace(strip(text), r"""^(["'])((?s:.*))\1$""", "$2")
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "\n{3,}", "\n\n")
    return strip(text)


def trim_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{PUNCTUATION}|{PUNCTUATION}$", "")


def is_table(text: Column) -> Column:
    """At least two non-blank lines, two of them with a bar, and half of all."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    bars = F.size(F.filter(lines, lambda x: x.contains("|")))
    return (F.size(lines) >= 2) & (bars >= 2) & (bars * 2 >= F.size(lines))


def content_type(source: Column) -> Column:
    """By file extension; URLs without a known one are web pages, anything else is unknown."""
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    suffix = F.lower(F.regexp_extract(F.regexp_replace(source, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(table, suffix), F.when(source.rlike("^https?://"), "web_page").otherwise("unknown"))


def title_case(key: Column) -> Column:
    """``snake_case`` keys as ``Snake Case``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def byte_truncate(text: Column, limit: int = 60_000) -> Column:
    """At most ``limit`` UTF-8 bytes; a code point that does not fit wholly is left out."""
    cut = F.encode(text, "UTF-8").substr(1, limit)
    whole = F.regexp_replace(F.hex(cut), "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    # Pairs of hex digits stay aligned, as the length is even; only a cut code point ends in a leading byte's remains.
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


#: The common HTML entities, the ampersand's last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_to_text(html: Column) -> Column:
    """Scripts, styles, comments and tags off; the common entities decoded; white space single."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_to_markdown(html: Column) -> Column:
    """As :func:`html_to_text`, with headings, list items, paragraphs and breaks as markdown lines."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i) ?<h{level}(?:\s[^>]*)?> ?", "\n\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?i) ?<li(?:\s[^>]*)?> ?", "\n- ")
    text = F.regexp_replace(text, r"(?i) ?</?(?:p|div|section|article|ul|ol|table|tr|h[1-6])(?:\s[^>]*)?> ?", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i) ?<br\s*/?> ?", "\n"), r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def occurrences(text: Column, span: Column) -> Column:
    """Number of non-overlapping occurrences of ``span``; none of an empty one."""
    return F.when(F.length(span) > 0, ((F.length(text) - F.length(F.replace(text, span, F.lit("")))) / F.length(span)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def occurrence_starts(text: Column, span: Column) -> Column:
    """Starts (0-based) of the non-overlapping occurrences of ``span``, from the left."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    step = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos")), lambda a, p: F.struct(F.array_append(a["at"], a["pos"] + F.length(p)).alias("at"), (a["pos"] + F.length(p) + F.length(span)).alias("pos")), lambda a: a["at"])
    return F.when((F.length(span) > 0) & text.contains(span), step).otherwise(F.array().cast("array<int>"))
