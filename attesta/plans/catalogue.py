"""The engine's own queries, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import templates, text
from attesta.functions.vectors import prune
from attesta.operators import chunk, docgen, evaluate, intent, metadata, records, retrieve, spans, structured, training
from attesta.operators.filters import compile_filter
from attesta.plans import documents
from attesta.plans.answer import answer
from attesta.session import scratch_folder
from attesta.sources import readers
from attesta.sources.index import Index
from attesta.sources.store import Store
from attesta.streaming.ingest import latest_stage, stage_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query (tables in, DataFrame out) and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: readers.read_table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_BUILT: dict[tuple, object] = {}


def _built(kind: str, table: DataFrame, make: Callable[[], object]):
    """What ``make`` builds from a table's files, built once an application: stores and indexes are there to be kept."""
    key = (table.sparkSession.sparkContext.applicationId, kind, *sorted(table.inputFiles()))
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


# Scans and filters


def _store(t):
    return _built("store", t("documents"), lambda: _new_store(t))


def _new_store(t):
    """A store of the documents, by language as their content type, and of their chunks."""
    docs = t("documents")
    store = Store(docs.sparkSession, f"{scratch_folder(docs.sparkSession)}/store")
    store.add_documents(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("raw_content"), "source", F.col("lang").alias("content_type"), "n_chars"))
    parts = chunk.numbered(chunk.chunk_fixed(docs, 512, 50, ident="doc_id").drop("chunk_number"))
    store.add_chunks(parts.join(docs.select(F.col("doc_id").alias("document_id"), "lang"), "document_id"))
    return store


_CHUNKS = "SELECT doc_id, lang, CAST(i AS INTEGER) AS chunk_number, sha256(doc_id || '|' || i) AS id FROM (SELECT doc_id, lang, unnest(range(0, ceil(length(text) / 462)::BIGINT)) AS i FROM documents WHERE length(text) > 0)"


@query(f"SELECT doc_id, chunk_number, 1e0 AS score FROM ({_CHUNKS}) WHERE lang = 'en' AND chunk_number > 0 ORDER BY id LIMIT 100")
def scan_filter_only(t):
    return _store(t).scan('lang == "en" && chunk_number > 0', 100).select(F.col("document_id").alias("doc_id"), "chunk_number", "score")


@query("SELECT doc_id, text, lang, source FROM documents WHERE doc_id = 7")
def document_lookup(t):
    return _store(t).document(7).select(F.col("id").alias("doc_id"), F.col("raw_content").alias("text"), F.col("content_type").alias("lang"), "source")


@query(f"SELECT doc_id, chunk_number FROM ({_CHUNKS}) WHERE doc_id = 7 ORDER BY chunk_number LIMIT 100")
def chunks_of_document(t):
    return _store(t).chunks_of(7).select(F.col("document_id").alias("doc_id"), "chunk_number")


@query(f"SELECT doc_id FROM (SELECT doc_id, min(id) AS first FROM (SELECT * FROM ({_CHUNKS}) ORDER BY id LIMIT 200) GROUP BY doc_id ORDER BY first LIMIT 20)")
def documents_of_chunks(t):
    return _store(t).documents_of_chunks(20).select(F.col("document_id").alias("doc_id"))


@query("SELECT doc_id, source, CAST(length(text) AS INTEGER) AS content_length FROM documents ORDER BY doc_id LIMIT 1000")
def list_documents(t):
    return _store(t).documents().select(F.col("id").alias("doc_id"), "source", F.length("raw_content").alias("content_length"))


@query("SELECT event_id, event_type FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND event_type IN ('click', 'purchase')")
def filter_json_path(t):
    events = t("events")
    return events.where(compile_filter('props["k"] >= 50 and event_type in ["click", "purchase"]', events.columns, ("props",))).select("event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE text LIKE '%the and%' OR NOT (lang = 'en' OR n_chars <= 900)")
def filter_compound(t):
    docs = t("documents")
    return docs.where(compile_filter('text LIKE "%the and%" || not (lang == "en" || n_chars <= 900)', docs.columns)).select("doc_id")


# Sources and metadata

_SUFFIX = "lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1))"


@query(f"""
SELECT page_id, CASE WHEN {_SUFFIX} IN ('pdf', 'docx', 'csv', 'json', 'html', 'txt') THEN {_SUFFIX}
  WHEN {_SUFFIX} = 'htm' THEN 'html' WHEN {_SUFFIX} IN ('md', 'markdown') THEN 'markdown' ELSE 'web_page' END AS content_type FROM pages""")
def detect_url_type(t):
    return t("pages").select("page_id", text.content_type(F.col("url")).alias("content_type"))


_HTML = r"regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
_DECODED = f"replace(replace(replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(rf"SELECT page_id, trim(regexp_replace({_DECODED}, '\s+', ' ', 'g')) AS body FROM pages")
def html_to_text(t):
    return readers.pages_as_documents(t("pages")).select(F.col("id").alias("page_id"), F.col("raw_content").alias("body"))


def _described(t):
    pairs = [x for c in ("lang", "source", "user_id") for x in (F.lit(c), F.concat(F.col("lang"), F.lit("_u")) if c == "user_id" else F.col(c))]
    return t("documents").withColumn("metadata", F.create_map(*pairs))


@query("""
SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || 'Document: Doc ' || doc_id
  || chr(10) || 'Source: ' || source || chr(10) || 'Lang: ' || lang || chr(10) || 'Source: ' || source AS enhanced FROM documents""")
def metadata_footer(t):
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    return _described(t).select("doc_id", metadata.footer(F.col("text"), title, F.col("source"), F.col("metadata")).alias("enhanced"))


@query("SELECT doc_id, 'chunk' AS lang, source, CAST(n_chars AS VARCHAR) AS size, lang || '_u' AS user_id FROM documents")
def metadata_merge(t):
    base, own = F.col("metadata"), F.create_map(F.lit("lang"), F.lit("chunk"), F.lit("size"), F.col("n_chars").cast("string"))
    rows = metadata.promote(_described(t).withColumn("metadata", metadata.merge(base, own)), keys=("user_id",))
    return rows.select("doc_id", *[F.element_at("metadata", c).alias(c) for c in ("lang", "source", "size")], "user_id")


@query("SELECT d.doc_id, coalesce('{\"quality\":' || l.quality || '}', '{}') AS metadata FROM documents d LEFT JOIN labels l USING (doc_id)")
def sidecar_join(t):
    side = t("labels").select("doc_id", F.to_json(F.struct("quality")).alias("metadata"))
    return readers.with_sidecar(t("documents").select("doc_id"), side, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_antijoin(t):
    return readers.not_yet(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT doc_id, count(*) AS n_chunks FROM (SELECT doc_id, unnest(range(0, length(text), 462)) FROM documents WHERE length(text) > 0) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id")
def delete_document(t):
    store = _new_store(t)
    store.delete_documents(t("labels").where("quality = 0").select(F.col("doc_id").alias("id")))
    return store.read("chunks").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_chunks"))


@query(f"""
SELECT d.lang AS content_type, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_CHUNKS}) GROUP BY doc_id) USING (doc_id) GROUP BY d.lang""")
def index_inspect(t):
    return _store(t).inspect()


@query("""
SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i), '') AS text FROM (
  SELECT doc_id, i, c, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM (
    SELECT doc_id, i, substr(text, i, 1) AS c FROM documents, range(1, 201) r(i) WHERE i <= length(text))) WHERE bytes <= 200 GROUP BY doc_id
UNION ALL SELECT doc_id, text FROM documents WHERE text = ''""")
def byte_truncate(t):
    return t("documents").select("doc_id", text.byte_truncate(F.col("text"), 200).alias("text"))


# Chunking and text


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_number, trim(substr(text, i * 462 + 1, 512), {_WHITE}) AS text
FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 462)::BIGINT)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(t):
    return chunk.chunk_fixed(t("documents"), ident="doc_id").select(F.col("document_id").alias("doc_id"), "chunk_number", "text")


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_number, sha256(doc_id || '|' || i) AS id, CAST(i * 300 AS INTEGER) AS start
FROM (SELECT doc_id, unnest(range(0, ceil(length(text) / 300)::BIGINT)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_ids(t):
    parts = chunk.numbered(chunk.chunk_fixed(t("documents"), 300, 0, ident="doc_id").drop("chunk_number"))
    return parts.select(F.col("document_id").alias("doc_id"), "chunk_number", "id", "start")


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_number, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))")
def chunk_sentences(t):
    return chunk.chunk_sentences(t("documents"), ident="doc_id").select(F.col("document_id").alias("doc_id"), "chunk_number", "text")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_number, array_to_string(w[i * 80 + 1:i * 80 + 100], ' ') AS text
FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ceil(len(w) / 80)::BIGINT))) AS i FROM w)""")
def chunk_words(t):
    return chunk.chunk_words(t("documents"), 100, 20, ident="doc_id").select(F.col("document_id").alias("doc_id"), "chunk_number", "text")


def _markdown(t):
    """Documents as markdown: a title, a section by language and one by source, around the text's halves."""
    half = F.expr("cast(length(text) / 2 as int)")
    body = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n## "), F.col("lang"), F.lit("\n"), F.expr("substring(text, 1, cast(length(text) / 2 as int))"), F.lit("\n### "), F.col("source"), F.lit("\n"), F.col("text").substr(half + 1, F.length("text")), F.lit("\n## End\nlast\n"))
    return t("documents").select("doc_id", body.alias("text"))


_MD = "'# Doc ' || doc_id || chr(10) || '## ' || lang || chr(10) || substr(text, 1, length(text) // 2) || chr(10) || '### ' || source || chr(10) || substr(text, length(text) // 2 + 1) || chr(10) || '## End' || chr(10) || 'last' || chr(10)"
_HEADS = rf"""
WITH l AS (SELECT doc_id, x, unnest(range(0, len(x))) AS line FROM (SELECT doc_id, string_split({_MD}, chr(10)) AS x FROM documents)),
h AS (SELECT doc_id, line, x[line + 1] AS s FROM l WHERE regexp_matches(x[line + 1], '^#{{1,6}}[ \t]+'))"""


@query(_HEADS + r"""
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(length(regexp_extract(s, '^(#+)', 1)) AS INTEGER) AS level, trim(regexp_replace(s, '^#+', '')) AS title,
       CAST(lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS INTEGER) AS next_line FROM h""")
def header_blocks(t):
    return chunk.header_blocks(_markdown(t), ident="doc_id").withColumnRenamed("document_id", "doc_id")


@query(_HEADS + r"""
, g AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(length(regexp_extract(s, '^(#+)', 1)) AS INTEGER) AS level, trim(regexp_replace(s, '^#+', '')) AS title FROM h)
SELECT a.doc_id, a.line, a.level, a.title,
  coalesce((SELECT string_agg(b.title, ' > ' ORDER BY b.line) FROM g b WHERE b.doc_id = a.doc_id AND b.line < a.line AND b.level < a.level
    AND NOT EXISTS (SELECT 1 FROM g c WHERE c.doc_id = a.doc_id AND c.line > b.line AND c.line < a.line AND c.level <= b.level)), '') AS path
FROM g a""")
def heading_path(t):
    return chunk.heading_paths(_markdown(t), ident="doc_id").withColumnRenamed("document_id", "doc_id")


@query()
def chunk_markdown(t):
    return chunk.chunk_markdown(_markdown(t), chunk.Markdown(smallest=40, largest=2000), ident="doc_id").drop("enhanced_text")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS INTEGER) AS n_distinct FROM documents")
def token_counts(t):
    w = text.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x FROM documents),
n AS (SELECT doc_id, len(x) AS n, len(list_filter(x, lambda y: contains(y, '|'))) AS b FROM l)
SELECT doc_id, n >= 2 AND b >= 2 AND b * 2 >= n AS is_table FROM n""")
def table_test(t):
    return t("documents").select("doc_id", text.is_table(F.col("text")).alias("is_table"))


# Retrieval

_PAIR = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"


def _dense_sql(where: str = "true") -> str:
    return f"""
SELECT question_id, id, score, rank FROM (
  SELECT q.vec_id AS question_id, e.vec_id AS id, {_PAIR} AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIR} DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND ({where})) WHERE rank <= 10"""


def _asked(t):
    return t("embeddings").where("vec_id % 50 = 0")


_VECTORS = {"ident": "vec_id", "vector": "embedding", "query_id": "vec_id", "query_vector": "embedding"}


@query(_dense_sql())
def dense_topk(t):
    return retrieve.dense_topk(t("embeddings"), _asked(t), 10, **_VECTORS)


@query(_dense_sql("e.label < 5"))
def dense_topk_filtered(t):
    return retrieve.dense_topk(t("embeddings"), _asked(t), 10, where=F.col("label") < 5, **_VECTORS)


@query()
def dense_ivf(t):
    """Searched by an inverted file; recall against dense_topk is measured in the tests."""
    e = t("embeddings")
    index = _built("lists", e, lambda: retrieve.InvertedFile(e, 16, ident="vec_id", vector="embedding"))
    return index.search(_asked(t), 10, 12, query_id="vec_id", query_vector="embedding")


def _postings_sql(table: str, key: str, size: int = 4096) -> str:
    place = f"CAST(('0x' || substr(md5(term), 1, 6))::BIGINT % {size} AS INTEGER)"
    return f"SELECT {key} AS id, {place} AS place, 1 + ln(count(*)) AS weight FROM (SELECT {key}, unnest({_TOKENS}) AS term FROM {table}) GROUP BY 1, 2"


def _postings(t, table: str, key: str):
    return retrieve.sparse_vectors(t(table), ident=key, size=4096)


@query(f"SELECT id AS doc_id, place, round(weight, 6) AS weight FROM ({_postings_sql('documents', 'doc_id')})")
def sparse_embed(t):
    return _postings(t, "documents", "doc_id").select(F.col("id").alias("doc_id"), "place", F.round("weight", 6).alias("weight"))


@query(f"SELECT id AS doc_id, CAST(count(*) AS INTEGER) AS kept FROM ({_postings_sql('documents', 'doc_id')}) WHERE weight - 1 > 1e-6 GROUP BY 1")
def sparse_prune(t):
    rows = _postings(t, "documents", "doc_id").groupBy(F.col("id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("place", (F.col("weight") - 1)))).alias("v"))
    return rows.select("doc_id", F.size(prune(F.col("v"))).alias("kept")).where("kept > 0")


def _sparse_sql(size: int = 4096) -> str:
    return f"""
SELECT question_id, id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
  SELECT q.id AS question_id, d.id, round(sum(d.weight * q.weight), 6) AS score
  FROM ({_postings_sql("documents", "doc_id", size)}) d JOIN ({_postings_sql("benchmark", "item_id", size)}) q USING (place) GROUP BY 1, 2)"""


_SPARSE = _sparse_sql()


def _sparse(t, k: int):
    q = _postings(t, "benchmark", "item_id").withColumnRenamed("id", "question_id")
    return retrieve.sparse_text_topk(t("documents"), q, k, ident="doc_id", size=4096)


@query(f"SELECT * FROM ({_SPARSE}) WHERE rank <= 10")
def sparse_topk(t):
    return _sparse(t, 10)


def _bm25_sql(where: str = "true") -> str:
    return f"""
SELECT question_id, id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
  WITH w AS (SELECT doc_id, lang, {_TOKENS} AS w FROM documents),
  s AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM w),
  tf AS (SELECT doc_id, lang, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, lang, len(w)::DOUBLE AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
  df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
  q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark)
  SELECT item_id AS question_id, doc_id AS id,
         round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), s WHERE {where} GROUP BY 1, 2)"""


def _bm25(t, k: int, where=None):
    return retrieve.bm25_topk(t("documents"), t("benchmark"), k, ident="doc_id", query_id="item_id", where=where)


@query(f"SELECT * FROM ({_bm25_sql()}) WHERE rank <= 10")
def bm25_topk(t):
    return _bm25(t, 10)


@query(f"SELECT * FROM ({_bm25_sql(chr(39).join(['lang = ', 'en', '']))}) WHERE rank <= 10")
def bm25_topk_filtered(t):
    return _bm25(t, 10, F.col("lang") == "en")


def _fused_sql(lists: list[tuple[str, float]]) -> str:
    total = sum(w for _, w in lists)
    union = " UNION ALL ".join(f"SELECT question_id, id, {i} AS m, rank, {w / total}e0 / (60 + rank) AS s FROM ({sql}) WHERE rank <= 20" for i, (sql, w) in enumerate(lists))
    return f"""
SELECT question_id, id, rrf_score, round(1 - rrf_score, 9) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, first // 1000000, first % 1000000, id) AS INTEGER) AS rank FROM (
    SELECT question_id, id, round(sum(s), 9) AS rrf_score, min(m * 1000000 + rank) AS first FROM ({union}) GROUP BY 1, 2)) WHERE rank <= 10"""


@query(_fused_sql([(_bm25_sql(), 0.5), (_SPARSE, 0.5)]))
def hybrid_rrf(t):
    return retrieve.fuse({"full_text": _bm25(t, 20), "sparse": _sparse(t, 20)}, retrieve.sanitise_weights({"full_text": 1, "sparse": 1, "other": 3}), 10)


@query(_fused_sql([(_bm25_sql(), 0.7), (_SPARSE, 0.3)]))
def hybrid_rrf_weighted(t):
    return retrieve.fuse({"full_text": _bm25(t, 20), "sparse": _sparse(t, 20)}, {"full_text": 0.7, "sparse": 0.3}, 10)


def _text_index(t):
    docs = t("documents")

    def make() -> Index:
        index = Index(docs.sparkSession, f"{scratch_folder(docs.sparkSession)}/index")
        index.add_chunks(docs.select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars"))
        return index

    return _built("text", docs, make), t("benchmark").select(F.col("item_id").alias("id"), "text")


def _vector_index(t):
    e = t("embeddings")

    def make() -> Index:
        index = Index(e.sparkSession, f"{scratch_folder(e.sparkSession)}/index", full_text=False)
        index.add_chunks(e.select(F.col("vec_id").alias("id"), F.lit("").alias("text"), F.col("embedding").alias("dense"), "label"))
        return index

    return _built("vectors", e, make), _asked(t).select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))


_HIT = ("question_id", "id", "score", "rank")


@query(f"SELECT * FROM ({_bm25_sql(chr(39).join(['lang = ', 'en', '']))}) WHERE rank <= 10")
def search_full_text(t):
    index, asked = _text_index(t)
    return index.search(asked, 10, search_type="full_text", filter='lang == "en"').select(*_HIT)


@query(f"SELECT * FROM ({_sparse_sql(30522)}) WHERE rank <= 10")
def search_sparse(t):
    index, asked = _text_index(t)
    return index.search(asked, 10, search_type="sparse").select(*_HIT)


@query(_fused_sql([(_sparse_sql(30522), 0.3), (_bm25_sql(), 0.7)]))
def search_weighted(t):
    index, asked = _text_index(t)
    return index.search(asked, 10, weights={"full_text": 0.7, "sparse": 0.3, "dense": 1, "other": 2}).select(*_HIT[:2], "rrf_score", *_HIT[2:])


@query(_dense_sql("e.label < 5"))
def search_dense(t):
    index, asked = _vector_index(t)
    return index.search(asked, 10, search_type="dense", filter="label < 5", exact=True).select(*_HIT)


@query()
def search_lists(t):
    """The nearest lists alone; recall against search_dense is measured in the tests."""
    index, asked = _vector_index(t)
    return index.search(asked, 10, search_type="dense", probes=12).select(*_HIT)


@query(f"SELECT * FROM ({_bm25_sql()}) WHERE rank <= 5")
def rrf_single_method(t):
    return retrieve.fuse({"full_text": _bm25(t, 20)}, {"full_text": 2.0}, 5)


@query(f"""
SELECT question_id, id, rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank > 5, CASE WHEN rank <= 5 THEN n_chars END DESC NULLS LAST, rank) AS INTEGER) AS new_rank
FROM (SELECT * FROM ({_bm25_sql()}) WHERE rank <= 20) JOIN documents ON doc_id = id""")
def rerank_head_tail(t):
    hits = _bm25(t, 20).join(t("documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return retrieve.rerank(hits, F.col("n_chars"), 5).select("question_id", "id", "rank", "new_rank")


@query("""
WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (
    SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM (SELECT vec_id, embedding FROM embeddings), c)
SELECT vec_id AS question_id, label AS example_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""")
def template_match(t):
    e = t("embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    examples = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    examples = examples.select(F.col("label").alias("id"), F.lit("[DISPLAY_SPANS]").alias("template"), "vector")
    return retrieve.best_example(e, examples, ident="vec_id", vector="embedding").drop("template")


# Sets and counts


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedupe_documents(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("digest")


# Evidence


def _verified(t):
    return spans.verify_exact(t("documents"), t("benchmark").select(F.col("item_id").alias("span_id"), F.col("text").alias("span")))


_VERIFIED = "SELECT doc_id, item_id AS span_id, b.text AS span, strpos(d.text, b.text) - 1 AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


@query(f"SELECT doc_id, span_id, start FROM ({_VERIFIED})")
def verify_exact(t):
    return _verified(t).select("doc_id", "span_id", "start")


@query("SELECT item_id AS span_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def verify_reject(t):
    return t("benchmark").select(F.col("item_id").alias("span_id")).join(_verified(t), "span_id", "left_anti")


@query()
def verify_fuzzy(t):
    """Benchmark items in upper case with changed punctuation, found in the documents' own spelling."""
    changed = t("benchmark").select(F.col("item_id").alias("span_id"), F.regexp_replace(F.upper("text"), r"\.\s", " ; ").alias("span"))
    return spans.verify_fuzzy(t("documents"), changed)


@query("SELECT doc_id, item_id AS span_id, ((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text))::BIGINT AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def highlight_count(t):
    return spans.count_occurrences(t("documents"), t("benchmark").select(F.col("item_id").alias("span_id"), F.col("text").alias("span")))


@query("""
SELECT doc_id, CAST((2 * length(text) - length(replace(text, 'the', '')) - length(replace(text, 'and', ''))) // 3 AS INTEGER) AS n,
       CAST(((2 * length(text) - length(replace(text, 'the', '')) - length(replace(text, 'and', ''))) // 3) * 3 AS INTEGER) AS marked, true AS whole FROM documents""")
def highlight_fold(t):
    """No mark of "ther" is left, as each holds one of "the"; all segments together are the text."""
    marks = spans.highlights(F.col("text"), F.array(F.lit("the"), F.lit("ther"), F.lit("and")))
    parts = spans.segments(F.col("text"), F.col("m"))
    rows = t("documents").select("doc_id", "text", marks.alias("m")).select("doc_id", "text", "m", parts.alias("p"))
    marked = F.aggregate(F.filter("p", lambda x: x["highlighted"]), F.lit(0), lambda a, x: a + F.length(x["text"]))
    return rows.select("doc_id", F.size("m").alias("n"), marked.alias("marked"), (F.array_join(F.transform("p", lambda x: x["text"]), "") == F.col("text")).alias("whole"))


@query(f"""
SELECT span_id // 4 AS question_id, doc_id, span_id, CAST(row_number() OVER q AS INTEGER) AS number,
       CAST(row_number() OVER (PARTITION BY span_id // 4, doc_id ORDER BY start, span_id) - 1 AS INTEGER) AS highlight_index,
       CASE WHEN row_number() OVER q <= 5 THEN 'display' ELSE 'reference' END AS type
FROM ({_VERIFIED}) WINDOW q AS (PARTITION BY span_id // 4 ORDER BY doc_id, start, span_id)""")
def citation_numbers(t):
    """Four benchmark items make a question; each document that holds one cites it."""
    rows = _verified(t).withColumn("question_id", F.expr("span_id div 4"))
    return spans.citations(rows, order=("doc_id", "start", "span_id")).select("question_id", "doc_id", "span_id", "number", "highlight_index", "type")


@query(f"""
SELECT span_id // 4 AS document_id, span_id AS query_no, count(*) AS n_spans,
       CAST(coalesce(sum(count(*)) OVER (PARTITION BY span_id // 4 ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_number
FROM ({_VERIFIED}) GROUP BY span_id""")
def citation_offsets(t):
    rows = _verified(t).groupBy(F.expr("span_id div 4").alias("document_id"), F.col("span_id").alias("query_no")).agg(F.count("*").alias("n_spans"))
    return docgen.citation_offsets(rows)


def _reviewed(t):
    """Four benchmark items make a template; each is a query whose documents are those that hold it."""
    doc = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    rows = _verified(t).join(t("documents").select("doc_id", "text"), "doc_id")
    held = rows.groupBy(F.expr("span_id div 4").alias("document_id"), (F.expr("span_id % 4") + 1).alias("query_no")).agg(F.array_sort(F.collect_list(F.struct("doc_id", doc.alias("d"), F.struct(F.col("span").alias("text"), F.col("doc_id").cast("string").alias("doc")).alias("s")))).alias("x"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("params")
    reviewed = held.select("document_id", "query_no", F.transform("x", lambda v: v["s"]).alias("spans"), F.transform("x", lambda v: v["d"]).alias("docs"), none, F.lit(None).cast("string").alias("error"), (F.col("query_no") < 4).alias("approved"))
    ids = reviewed.select(F.col("document_id").alias("id")).distinct()
    return ids.withColumn("text", F.lit("[!query=a] [!query=b] [!query=c] [!query=d]")), reviewed


@query(f"""
WITH v AS (SELECT span_id // 4 AS document_id, span_id % 4 + 1 AS query_no, doc_id FROM ({_VERIFIED}) WHERE span_id % 4 < 3),
d AS (SELECT document_id, doc_id, row_number() OVER (PARTITION BY document_id ORDER BY first, doc_id) - 1 AS doc_index
      FROM (SELECT document_id, doc_id, min(query_no) AS first FROM v GROUP BY document_id, doc_id))
SELECT v.document_id, CAST(row_number() OVER (PARTITION BY v.document_id ORDER BY query_no, v.doc_id) AS INTEGER) AS number,
       CAST(doc_index AS INTEGER) AS doc_index, CAST(row_number() OVER (PARTITION BY v.document_id, v.doc_id ORDER BY query_no) - 1 AS INTEGER) AS highlight_index, CAST(v.doc_id AS VARCHAR) AS doc
FROM v JOIN d ON v.document_id = d.document_id AND v.doc_id = d.doc_id""")
def global_citations(t):
    done = documents.finalize(*_reviewed(t))
    rows = done.select("document_id", F.explode("citations").alias("c"), F.transform("documents", lambda d: d["id"]).alias("ids"))
    return rows.select("document_id", "c.number", "c.doc_index", "c.highlight_index", F.get("ids", F.col("c.doc_index")).alias("doc"))


_PROBS = f"SELECT doc_id, pos, ('0x' || substr(md5(w[pos + 1]), 1, 4))::BIGINT / 65536e0 AS p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))"


def _probs(t):
    rows = t("documents").select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "w"))
    return rows.select("doc_id", "pos", (F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("double") / 65536.0).alias("p"))


@query(f"""
WITH r AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ({_PROBS}) WHERE p > 0.5),
g AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM r GROUP BY doc_id, run HAVING count(*) >= 3),
n AS (SELECT doc_id, a, b, coalesce((a - lag(b) OVER w - 1 > 1)::INTEGER, 1) AS new FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
i AS (SELECT doc_id, a, b, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM n)
SELECT doc_id, CAST(min(a) AS INTEGER) AS first, CAST(max(b) AS INTEGER) AS last FROM i GROUP BY doc_id, island""")
def token_islands(t):
    return spans.token_islands(_probs(t)).drop("island")


@query(f"""
WITH s AS (SELECT doc_id, i, len(regexp_extract_all(lower(s[i]), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, used FROM (SELECT doc_id, i, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS used FROM s) WHERE used <= 100""")
def sentence_budget(t):
    rows = chunk.chunk_sentences(t("documents"), ident="doc_id").select(F.col("document_id").alias("doc_id"), F.col("chunk_number").alias("pos"), F.size(text.tokens(F.col("text"))).alias("n"))
    return spans.sentence_budget(rows, 100).select("doc_id", "pos", "used")


@query(f"SELECT question_id, id, CAST((rank - 1) // 5 AS INTEGER) AS batch, 'individual' AS mode FROM ({_bm25_sql()}) WHERE rank <= 12")
def batch_groups(t):
    return spans.micro_batches(_bm25(t, 12)).select("question_id", "id", "batch", "mode")


# Rendering

_SPANS = "list(span ORDER BY start, span_id)"


def _spans_of(t):
    rows = _verified(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "span_id", "span"))).alias("x"))
    return rows.select("doc_id", F.transform("x", lambda s: s["span"]).alias("spans"))


_LINES = "list_filter(string_split({0}, chr(10)), lambda x: trim(x) <> '')"
_BARS = "len(list_filter(" + _LINES + ", lambda x: contains(x, '|')))"
_GAP = f"CASE WHEN {_BARS.format('span')} >= 2 AND {_BARS.format('span')} * 2 >= len({_LINES.format('span')}) THEN chr(10) || chr(10) ELSE ' ' END"


@query(f"""
SELECT doc_id, 'Found:' || chr(10) || string_agg('[' || n || ']' || {_GAP} || span, chr(10) || chr(10) ORDER BY n) AS answer
FROM (SELECT doc_id, span, row_number() OVER (PARTITION BY doc_id ORDER BY start, span_id) AS n FROM ({_VERIFIED})) GROUP BY doc_id""")
def template_static(t):
    return _spans_of(t).select("doc_id", templates.fill(F.lit("Found:\n[DISPLAY_SPANS]"), F.col("spans")).alias("answer"))


@query(f"SELECT doc_id, 'First: [1]' || first({_GAP} || span ORDER BY start, span_id) || ' Refs:' AS answer FROM ({_VERIFIED}) GROUP BY doc_id")
def template_per_span(t):
    return _spans_of(t).select("doc_id", templates.fill(F.lit("First: [FACT_1] Refs: [CITATION_REFS]"), F.slice("spans", 1, 1)).alias("answer"))


@query(f"SELECT doc_id, string_agg(span, chr(10) || chr(10) ORDER BY start, span_id) AS answer FROM ({_VERIFIED}) GROUP BY doc_id")
def template_hidden(t):
    return _spans_of(t).select("doc_id", templates.fill(templates.ensure_placeholder(F.lit("[RELEVANT_SENTENCES]")), F.col("spans"), style="hidden").alias("answer"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace('a   b' || chr(10) || chr(10) || chr(10) || chr(10) || text, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9) || chr(13)) AS answer FROM documents""")
def clean_answer(t):
    return t("documents").select("doc_id", text.clean_answer(F.concat(F.lit('"a   b\n\n\n\n'), F.col("text"), F.lit('"'))).alias("answer"))


@query("SELECT doc_id, '[1] [3]' AS refs, 'METHOD,RESULT' AS names FROM documents")
def linked_citations(t):
    numbers = F.create_map(F.lit("v1"), F.lit(1), F.lit("v3"), F.lit(3))
    names = templates.placeholders(F.lit("[METHOD] [DISPLAY_SPANS] [RESULT] [FACT_2] [METHOD]"))
    return t("documents").select("doc_id", templates.linked_numbers(F.array(F.lit("v1"), F.lit("no"), F.lit("v3")), numbers).alias("refs"), F.array_join(names, ",").alias("names"))


def _template(t):
    body = F.concat(F.lit("# Report\n[!query=What is "), F.col("source"), F.lit("| format=bullet, max_length=40] and\n## Part **two**\n[!query=Which language]\nend"))
    return t("documents").select("doc_id", "lang", "source", body.alias("text"))


@query("""
SELECT doc_id, 1 AS query_no, 'What is ' || source AS question, 'bullet' AS format, 'Report' AS section FROM documents
UNION ALL SELECT doc_id, 2, 'Which language', NULL, 'Part two' FROM documents""")
def docgen_queries(t):
    return docgen.queries(_template(t), ident="doc_id").select(F.col("document_id").alias("doc_id"), "query_no", "question", F.try_element_at("params", F.lit("format")).alias("format"), "section")


@query("SELECT doc_id, '# Report' || chr(10) || '• ' || source || ' and' || chr(10) || '## Part **two**' || chr(10) || lang || chr(10) || 'end' AS text FROM documents")
def docgen_fill(t):
    first = templates.format_result(F.col("source"), F.lit("bullet"), F.lit(40))
    return _template(t).select("doc_id", docgen.fill(F.col("text"), F.array(first, F.col("lang"))).alias("text"))


@query(r"""
WITH c AS (SELECT conv_id, turn, text, regexp_matches(lower(text), '^\s*(hi|hello|thanks|bye)\b') AS greet, len(regexp_split_to_array(trim(text), '\s+')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN greet THEN 'smalltalk' WHEN contains(text, '?') OR n >= 5 THEN 'question' ELSE 'unclear' END AS intent,
       CASE WHEN greet THEN 'direct' WHEN n >= 5 THEN 'rag' ELSE 'ask_back' END AS route FROM c""")
def intent_route(t):
    d = intent.decide(intent.lexical_detector(F.col("text")), {"smalltalk": "direct", "question": "rag"}, 0.5, "ask_back")
    return t("conversations").select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.*")


# Evaluation


@query(r"""
WITH p AS (SELECT quality, CASE WHEN regexp_matches(text, '!!|\$\$|%%|\| ') THEN 0 ELSE 1 END AS predicted FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE quality = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND predicted = 1) AS fp,
             count(*) FILTER (WHERE quality = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE quality = predicted) AS ok, count(*) AS n FROM p),
r AS (SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, ok / n AS accuracy FROM c)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, round(accuracy, 6) AS accuracy FROM r""")
def eval_scores(t):
    rows = t("labels").join(t("documents"), "doc_id").withColumn("predicted", F.when(F.col("text").rlike(r"!!|\$\$|%%|\| "), 0).otherwise(1))
    return evaluate.binary_scores(rows, "quality", "predicted")


@query(f"""
WITH w AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM p""")
def eval_word_f1(t):
    """Each turn of a conversation against the next."""
    c = t("conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evaluate.word_f1(F.col("text"), F.col("after")), 6).alias("f1"))


@query("SELECT vec_id, round(exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)), 6) AS p FROM embeddings WHERE exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)) > 0.45")
def threshold_softmax(t):
    logits = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("no", "yes"))]
    return spans.sentences_over(t("embeddings").select("vec_id", *logits), "no", "yes", 0.45).select("vec_id", F.round("p", 6).alias("p"))


@query("SELECT epoch, round(avg(x), 6) AS loss FROM (SELECT epoch, batch, avg(x) AS x FROM (SELECT label % 3 AS epoch, label AS batch, vec_id % 7 AS doc, avg(embedding[1]::DOUBLE) AS x FROM embeddings GROUP BY 1, 2, 3) GROUP BY epoch, batch) GROUP BY epoch")
def mean_loss(t):
    rows = t("embeddings").select((F.col("label") % 3).alias("epoch"), F.col("label").alias("batch"), (F.col("vec_id") % 7).alias("doc"), F.get("embedding", F.lit(0)).cast("double").alias("loss"))
    return training.mean_loss(rows).select("epoch", F.round("loss", 6).alias("loss"))


@query("SELECT count(*) FILTER (WHERE quality = 1) AS processed, count(*) FILTER (WHERE quality = 0) AS failed, count(*) AS total FROM labels")
def outcome_counts(t):
    return training.outcome_counts(t("labels").withColumn("status", F.when(F.col("quality") == 1, "processed").otherwise("failed")))


@query(f"SELECT doc_id AS question_id, CAST(count(*) AS INTEGER) AS total, CAST(least(count(*), 2) AS INTEGER) AS displayed, CAST(greatest(count(*) - 2, 0) AS INTEGER) AS referenced FROM ({_VERIFIED}) GROUP BY doc_id")
def citation_counts(t):
    return training.citation_counts(_spans_of(t).select(F.col("doc_id").alias("question_id"), F.col("spans").alias("citations")), 2)


_SPLIT = "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents WHERE {_SPLIT} = 'dev'")
def sample_splits(t):
    named = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test")
    return training.of_split(t("documents").select("doc_id", training.split_name(named).alias("split")), "dev")


# Records


@query("SELECT doc_id, '' AS title, source, 'markdown' AS content_type, text AS raw_content, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def schema_to_document(t):
    rows = records.from_schema(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang", "n_chars"))
    return rows.select(F.col("id").alias("doc_id"), "title", "source", "content_type", "raw_content", *[F.element_at("metadata", c).alias(c) for c in ("lang", "n_chars")])


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def record_round_trip(t):
    docs = t("documents")
    return records.from_record(records.to_record(docs), docs.schema)


@query("SELECT doc_id, 'A' || chr(10) || 'B' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || 'Document: Unknown Document' || chr(10) || 'Source: ' || source || chr(10) || 'Page No: 3' AS enhanced FROM documents")
def enhanced_content(t):
    meta = F.create_map(F.lit("page_no"), F.lit("3"), F.lit("lang"), F.col("lang"), F.lit("user_id"), F.lit("u"))
    heads = F.array(F.lit("A"), F.lit("B"))
    return t("documents").select("doc_id", records.enhanced(F.col("text"), heads, F.lit(""), F.col("source"), meta).alias("enhanced"))


@query(f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n, min(id) AS first FROM ({_CHUNKS}) WHERE chunk_number < 3 GROUP BY doc_id")
def chunks_by_type(t):
    docs = t("documents").select(F.col("doc_id").alias("id"))
    parts = chunk.numbered(chunk.chunk_fixed(t("documents"), ident="doc_id").drop("chunk_number")).where("chunk_number < 3")
    held = records.attach_chunks(docs, parts.withColumn("chunk_type", F.lit("paragraph")))
    return records.chunks_by_type(held, "paragraph").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").cast("int").alias("n"), F.min("chunk.id").alias("first"))


@query("SELECT doc_id AS id, text, lang AS user_id FROM documents")
def output_fields(t):
    return records.output_fields(t("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("user_id"), "source", F.array(F.lit(1.0)).alias("dense")))


@query("SELECT doc_id, '3' AS page_number, 'kept' AS section_title, source FROM documents")
def retrieval_context(t):
    found = records.retrieval_context(F.lit(3), F.lit("lost"), F.create_map(F.lit("section_title"), F.lit("kept"), F.lit("source"), F.col("source")))
    return t("documents").select("doc_id", found.alias("m")).select("doc_id", *[F.element_at("m", c).alias(c) for c in ("page_number", "section_title", "source")])


@query("SELECT doc_id, substr(md5('What is ' || source || '|' || lang || ' | ' || source || '|2|1'), 1, 12) AS k FROM documents")
def template_key(t):
    return t("documents").select("doc_id", records.template_key(F.concat(F.lit("What is "), F.col("source")), F.array("lang", "source"), F.lit(1)).alias("k"))


@query("""
SELECT doc_id, '1. ' || substr(trim(replace(text, chr(10), ' '), chr(32) || chr(9)), 1, 100) || '...' || chr(10) || '2. ' || lang || '...' AS lines,
       substr(replace(text, chr(10), ' '), 1, 50) || '... | ' || lang || '...' AS preview FROM documents""")
def span_previews(t):
    two = F.array("text", "lang")
    return t("documents").select("doc_id", templates.span_lines(two).alias("lines"), templates.span_preview(two).alias("preview"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || lang || chr(10) || chr(10) || '[DISPLAY_SPANS]' || chr(10) || chr(10) || 'Additional relevant information can be found in [CITATION_REFS].'
  ELSE '## Response' || chr(10) || chr(10) || 'Based on the available documents:' || chr(10) || chr(10) || '[DISPLAY_SPANS]' || chr(10) || chr(10) || '---' || chr(10) || '*These excerpts are taken verbatim from the source documents to ensure accuracy.*' END AS template FROM documents""")
def template_contextual(t):
    """A frame that a model made, or the fallback where it gave nothing."""
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("About "), F.col("lang")))
    frame = templates.Strategy("contextual").template_for(F.col("source"), F.array("text"), (1 - F.col("doc_id") % 2).cast("int"), complete=lambda _: made)
    return t("documents").select("doc_id", frame.alias("template"))


@query("SELECT doc_id, '[1] ' || lang || ' [3] [2]' AS inline, '<a> ' || lang || ' <3> <x>' AS named FROM documents")
def linked_fill(t):
    shown = F.array(F.struct(F.col("lang").alias("text"), F.lit("a").alias("span_id"), F.array(F.lit("c2"), F.lit("none"), F.lit("c1")).alias("citation_ids")))
    cited = F.array(*[F.struct(F.lit("t").alias("text"), F.lit(s).alias("span_id"), F.lit(c).alias("citation_id")) for s, c in (("x", "c1"), (None, "c2"))])
    forms = {"inline": "[{number}]", "named": "<{span_id}>"}
    return t("documents").select("doc_id", *[templates.fill_linked(F.lit("[DISPLAY_SPANS] [CITATION_REFS]"), shown, cited, form=f).alias(n) for n, f in forms.items()])


@query(f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
SELECT doc_id, CAST(i * 80 AS INTEGER) AS first, CAST(least(100, len(w) - i * 80) AS INTEGER) AS n
FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 20) / 80)::BIGINT))) AS i FROM w)""")
def token_windows(t):
    rows = t("documents").select("doc_id", F.explode(spans.token_windows(text.tokens(F.col("text")), 100, 20)).alias("w"))
    return rows.select("doc_id", "w.first", F.size("w.tokens").alias("n"))


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents)
SELECT doc_id, CAST(i // 2 AS INTEGER) AS chunk_number, array_to_string(s[i + 1:i + 3], ' ') AS text
FROM (SELECT doc_id, s, unnest(range(0, greatest(len(s) - 1, 1), 2)) AS i FROM s WHERE len(s) > 0)""")
def chunk_preset_qa(t):
    config = chunk.ChunkConfig(**{k: v for k, v in chunk.PRESETS["qa"].items()})
    return chunk.chunk(t("documents"), config, ident="doc_id").withColumnRenamed("document_id", "doc_id")


@query("SELECT doc_id, 'word' AS strategy, CASE WHEN lang = 'en' THEN 'default' ELSE 'markdown' END AS recipe, CAST(n_chars AS INTEGER) AS size, CAST(50 AS INTEGER) AS overlap, lang <> 'en' AS headings FROM documents")
def chunk_config(t):
    meta = F.create_map(F.lit("chunker_type"), F.lit("WORD"), F.lit("chunk_size"), F.col("n_chars").cast("string"), F.lit("chunk_overlap"), F.lit("many"))
    c = chunk.config_columns(meta, F.when(F.col("lang") == "en", "txt").otherwise("markdown"))
    return t("documents").select("doc_id", c.alias("c")).select("doc_id", *[f"c.{n}" for n in ("strategy", "recipe", "size", "overlap", "headings")])


@query(rf"""
WITH b AS (SELECT page_id, trim(regexp_replace({_DECODED}, '\s+', ' ', 'g')) AS body FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS chunk_number, trim(substr(body, i * 462 + 1, 512)) AS text
FROM (SELECT page_id, body, unnest(range(0, ceil(length(body) / 462)::BIGINT)) AS i FROM b WHERE length(body) > 0)""")
def page_chunks(t):
    return readers.pages_as_chunks(t("pages")).select(F.col("document_id").alias("page_id"), "chunk_number", "text")


@query("SELECT sha256(url) AS id, url AS source, regexp_extract(url, '([^/]+)/?$', 1) AS title FROM pages")
def schema_from_url(t):
    return readers.from_sources(t("pages"), "url", "html").select("id", "source", "title")


# Whole pipelines


def _answers(t):
    questions = t("benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return answer(questions, t("documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def e2e_answer(t):
    return _answers(t).select("question_id", "question", "answer", F.to_json("citations").alias("citations"))


@query()
def stage_stream(t):
    return stage_rows(_answers(t))


@query()
def stage_latest(t):
    return latest_stage(stage_rows(_answers(t)))


# Structured answers and hits


@query(f"""
SELECT doc_id, 'M: [1] ' || first(span ORDER BY start, span_id) || ' N: (no relevant information found) again [2] ' || first(span ORDER BY start, span_id) AS answer
FROM ({_VERIFIED}) GROUP BY doc_id""")
def structured_fill(t):
    first = F.get("spans", F.lit(0))
    raw = F.to_json(F.create_map(F.lit("METHOD"), F.array(first, F.lit("this stands nowhere!?"))))
    rows = _spans_of(t).join(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", "text", structured.normalise(raw).alias("v"))
    rows = rows.withColumn("v", F.transform_values("v", lambda _, s: structured.verified(s, F.array("text"))))
    return rows.select("doc_id", templates.fill_structured(F.lit("M: [METHOD] N: [NOTE] again [METHOD]"), F.col("v")).alias("answer"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS dataset_id FROM events")
def hits_to_results(t):
    rows = structured.hits_to_results(t("events").select("event_id", F.col("props").alias("metadata"), F.col("event_type").alias("dataset_id")))
    return rows.select("event_id", F.try_element_at("metadata", F.lit("k")).alias("k"), F.element_at("metadata", "dataset_id").alias("dataset_id"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under')")
def contains_search(t):
    return structured.containing(t("documents"), "text", "LICENSED under").select("doc_id")


@query("SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS first, 2 AS n FROM documents")
def citation_markers(t):
    marked = F.concat(F.lit("a ["), (F.col("doc_id") % 7).cast("string"), F.lit("] `[9]` b [12] ```\n[3]\n```"))
    found = structured.citation_markers(marked)
    return t("documents").select("doc_id", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("n"))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS place, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def mean_pool(t):
    rows = structured.mean_pool(t("embeddings"), "label", "embedding")
    return rows.select("label", F.posexplode("vector").alias("place", "x")).select("label", "place", F.round("x", 6).alias("x"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS again FROM events")
def storage_times(t):
    rows = t("events").select("event_id", "ts", F.col("ts").cast("timestamp").alias("created_at"), F.lit("x").alias("content"))
    out = metadata.storage_row(rows).withColumn("iso", metadata.iso_time(F.col("ts")))
    return out.select("event_id", "created_at", "iso", F.unix_timestamp(metadata.from_iso(F.col("iso"))).alias("again"))


@query()
def templated_documents(t):
    body = F.concat(F.lit("# Report "), F.col("item_id").cast("string"), F.lit("\n[!query="), F.regexp_replace("text", r"[\[\]|]", " "), F.lit("| format=bullet]\nend"))
    asked = t("benchmark").select(F.col("item_id").alias("id"), body.alias("text"))
    return documents.process(asked, t("documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def flat_highlights(t):
    return structured.flat_highlights(_answers(t))
