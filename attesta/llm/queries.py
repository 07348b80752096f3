"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, decontaminate, exact_dedup, license_scan, line_dedup, pii, quality, secrets, simhash, toxicity
from attesta.sources.readers import read_table


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, sf_dir, table)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("th")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
}

_KEY = "translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ",\n  ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in license_scan.TEMPLATES)


_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _shingles(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i
        FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"""


ORACLE_SQL = {
    "op1_license_scan": f"""
WITH t(license_id, text) AS (VALUES
  {_TEMPLATES}),
tg AS (SELECT license_id, {_BIGRAMS} AS grams FROM (SELECT license_id, {_W.format("text")} AS w FROM t)),
u AS (SELECT DISTINCT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\\n\\s*\\n'), string_split(text, chr(10)),
        string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS unit FROM documents),
ug AS (SELECT doc_id, {_BIGRAMS} AS g FROM (SELECT doc_id, {_W.format("unit")} AS w FROM u)),
d AS (SELECT doc_id, license_id, 2e0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
      FROM ug JOIN tg ON len(g) BETWEEN 0.6 * len(grams) AND 1.6 * len(grams))
SELECT doc_id, license_id, max(dice) AS dice, count(*) AS n_units FROM d WHERE dice >= 0.8 GROUP BY doc_id, license_id""",
    "op4_decontaminate": f"""
WITH d AS ({_shingles("documents", "doc_id")}),
i AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles""",
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
