"""Queries of chunking, search, fusion, context and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions.text import strip, words
from quarry.operators import bm25, chunking, context, fusion, sync, vectors
from quarry.operators.engine import Engine
from quarry.operators.predicates import Filter, compile_filters
from quarry.operators.store import Table
from quarry.plans.common import sql_by_paragraphs, sql_by_sentences, sql_collapse, sql_strip, sql_words, table
from quarry.sources import corpus
from quarry.storage import shared_dir, written

QUERIES, ORACLES = {}, {}
C = lambda c: F.col(c)


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


# Chunking. The test texts have no headings, so some are built around them.

SQL_SHORT = f"len({sql_words('text')}) <= 250"


def _markdown():
    return F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n\n## "), "lang", F.lit("\n\n"), "text", F.lit("\n### \n#### no heading\n# Empty"))


@query(f"SELECT doc_id || '_0' AS chunk_id, '**' || source || '/' || doc_id || '**' || chr(10) || chr(10) || text AS content FROM documents WHERE {SQL_SHORT}")
def chunk_small_docs(spark, d):
    docs = corpus.documents(spark, d).filter(F.size(words(C("content"))) <= chunking.MAX_WORDS)
    return chunking.chunk_documents(docs).select("chunk_id", "content")


@query(f"""WITH parts AS (SELECT doc_id, 0 AS pos, source AS title, {sql_strip('text')} AS body FROM documents UNION ALL
  SELECT doc_id, 1, lang, {sql_strip("text || chr(10) || '### ' || chr(10) || '#### no heading'")} FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, title, body FROM parts WHERE body <> ''""")
def chunk_sections(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunking.sections(_markdown())).alias("pos", "s")).select("doc_id", C("pos").cast("long").alias("pos"), "s.title", "s.body")


@query("SELECT doc_id, '**' || source || '**' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '### ' || lang || chr(10) || chr(10) ELSE '' END || text AS content FROM documents")
def chunk_build(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.chunk_text(C("source"), F.when(C("doc_id") % 2 == 0, C("lang")).otherwise(""), C("text")).alias("content"))


TWO = "text || chr(10) || chr(10) || left(text, 400) || repeat(chr(10), 2) || ' ' || repeat(chr(10), 2) || text"


@query(f"""WITH RECURSIVE {sql_by_paragraphs('p', f'SELECT doc_id::VARCHAR AS key, {TWO} AS text FROM documents')}
SELECT key::BIGINT AS doc_id, (row_number() OVER (PARTITION BY key ORDER BY i, j, k) - 1)::INTEGER AS pos, body FROM p""")
def chunk_paragraphs(spark, d):
    two = F.concat("text", F.lit("\n\n"), F.left("text", F.lit(400)), F.lit("\n\n \n\n"), "text")
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.by_paragraphs(two)).alias("pos", "body"))


@query(f"""WITH RECURSIVE {sql_by_sentences('s', 'SELECT doc_id::VARCHAR AS key, text FROM documents')}
SELECT key::BIGINT AS doc_id, (row_number() OVER (PARTITION BY key ORDER BY i, j) - 1)::INTEGER AS pos, body FROM s""")
def chunk_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.by_sentences(C("text"))).alias("pos", "body"))


SQL_MARKDOWN = "'# ' || source || chr(10) || text || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text || chr(10) || '### ' || chr(10) || '#### no heading' || chr(10) || '# Empty'"


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id::VARCHAR AS id, source, {SQL_MARKDOWN} AS content, text, lang FROM documents),
short AS (SELECT *, len({sql_words('content')}) <= 250 AS whole FROM docs),
sections AS (SELECT id, 0 AS n, source AS title, {sql_strip('text')} AS body FROM short WHERE NOT whole UNION ALL SELECT id, 1, lang, {sql_strip("text || chr(10) || '### ' || chr(10) || '#### no heading'")} FROM short WHERE NOT whole),
sized AS (SELECT *, len({sql_words('body')}) <= 250 AS fits FROM sections WHERE body <> ''),
{sql_by_paragraphs('p', "SELECT id || '/' || n AS key, body AS text FROM sized WHERE NOT fits")},
parts AS (SELECT id, 0 AS n, 0 AS i, 0 AS j, 0 AS k, NULL AS title, content AS body FROM short WHERE whole UNION ALL SELECT id, n, 0, 0, 0, title, body FROM sized WHERE fits
  UNION ALL SELECT id, n, i, j, k, title, p.body FROM sized JOIN p ON p.key = id || '/' || n WHERE NOT fits),
placed AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY n, i, j, k) - 1)::INTEGER AS chunk_index FROM parts)
SELECT id || '_' || chunk_index AS chunk_id, id AS document_id, source AS document_title, chunk_index, nullif(title, '') AS section_title,
  '**' || source || '**' || chr(10) || chr(10) || CASE WHEN title <> '' THEN '### ' || title || chr(10) || chr(10) ELSE '' END || body AS content, body FROM placed JOIN docs USING (id)""")
def chunk_documents(spark, d):
    docs = table(spark, d, "documents").select(C("doc_id").cast("string").alias("id"), C("source").alias("title"), _markdown().alias("content"))
    return chunking.chunk_documents(docs)


# Stored points


@query("SELECT doc_id || '_0' AS chunk_id, doc_id::VARCHAR AS document_id, source || '/' || doc_id AS document_title, text AS content FROM documents WHERE text IS NOT NULL")
def scan_chunks(spark, d):
    docs = corpus.documents(spark, d).filter("content IS NOT NULL")
    rows = docs.select(F.concat("id", F.lit("_0")).alias("chunk_id"), C("id").alias("document_id"), C("title").alias("document_title"), "content")
    return sync.checked_points(rows)


@query("""SELECT o_orderkey AS point_id, o_custkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def upsert_merge(spark, d):
    o = table(spark, d, "orders").select(C("o_orderkey").alias("point_id"), C("o_custkey").alias("document_id"))
    return sync.upsert(o.filter("point_id % 2 = 0").withColumn("version", F.lit("old")), o.filter("point_id % 3 = 0").withColumn("version", F.lit("new")), "point_id")


@query("SELECT o_orderkey AS point_id, o_custkey AS document_id FROM orders WHERE o_custkey % 5 <> 0")
def delete_documents(spark, d):
    o = table(spark, d, "orders").select(C("o_orderkey").alias("point_id"), C("o_custkey").alias("document_id"))
    return sync.delete_documents(o, o.filter("document_id % 5 = 0").select("document_id"))


def _stored_orders(spark, d):
    """All orders as points of their customers, written as one batch into a new table."""
    stored = Table(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "chunk_id string, document_id string, status string, version string", ("chunk_id", "document_id"), bloom=("document_id",), order=("document_id",))
    rows = table(spark, d, "orders").select(C("o_orderkey").cast("string").alias("chunk_id"), C("o_custkey").cast("string").alias("document_id"), C("o_orderstatus").alias("status"), F.lit("old").alias("version"))
    stored.write(rows)
    return stored, rows


@query("SELECT o_orderkey::VARCHAR AS chunk_id, o_custkey::VARCHAR AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS version FROM orders")
def store_upsert(spark, d):
    """Finished orders come again: their rows replace the stored ones by chunk_id, and segments are merged."""
    stored, rows = _stored_orders(spark, d)
    again = rows.filter("status = 'F'").withColumn("version", F.lit("new"))
    stored.write(again, {"chunk_id": again.select(C("chunk_id").alias("key"))})
    stored.compact(least=2)
    return stored.read().select("chunk_id", "document_id", "version")


@query("SELECT o_orderkey::VARCHAR AS chunk_id, o_custkey::VARCHAR AS document_id FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)")
def store_delete(spark, d):
    """The orders of a market segment's customers go; nothing comes in."""
    stored, _ = _stored_orders(spark, d)
    stored.write(None, {"document_id": table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(C("c_custkey").cast("string").alias("key"))})
    return stored.read().select("chunk_id", "document_id")


SQL_BATCHED = """tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens FROM documents WHERE lang IS DISTINCT FROM 'es'),
corpus AS (SELECT count(*) AS n FROM tok),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY term), corpus)"""


@query(f"WITH {SQL_BATCHED} SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS idf FROM raw")
def index_batches(spark, d):
    """The index after three batches: English documents come, then all others, then the Spanish ones go."""
    docs = table(spark, d, "documents").select(C("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    path, none = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}", docs.limit(0)
    english, spanish = F.coalesce(C("lang") == "en", F.lit(False)), F.coalesce(C("lang") == "es", F.lit(False))
    for fresh, gone in ((docs.filter(english), none), (docs.filter(~english), none), (none, docs.filter(spanish))):
        bm25.update(spark, path, fresh.select("chunk_id", "text"), gone.select("chunk_id", "text"))
    return bm25.Index.load(spark, path).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


SQL_SYNC = """plan AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 4 = 1 OR c_custkey % 9 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM customer WHERE c_custkey % 6 > 0)"""


def _sync(spark, d):
    c = table(spark, d, "customer").select(C("c_custkey").alias("document_id"))
    now = c.filter("document_id % 6 > 0").withColumn("last_edited_time", F.when(C("document_id") % 9 == 0, "").otherwise("2024-02-01"))
    stored = c.filter("document_id % 4 > 0").withColumn("last_edited_time", F.when(C("document_id") % 9 == 0, "").when(C("document_id") % 4 == 1, "2024-01-01").otherwise("2024-02-01"))
    return sync.plan(now, stored)


@query(f"WITH {SQL_SYNC} SELECT * FROM plan")
def sync_plan(spark, d):
    return _sync(spark, d)


@query(f"WITH {SQL_SYNC} SELECT count(*) AS documents_seen, count_if(action = 'new')::BIGINT AS documents_new, count_if(action = 'changed')::BIGINT AS documents_changed, count_if(action = 'unchanged')::BIGINT AS documents_skipped FROM plan")
def sync_metrics(spark, d):
    return sync.counters(_sync(spark, d))


# Lexical search: benchmark passages as queries


SQL_BM25 = """tok AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(concat_ws(chr(10), concat_ws('/', source, doc_id::VARCHAR), text)), '[a-z0-9]+') AS tokens FROM documents),
corpus AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY chunk_id, term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY query_id, term),
scored AS (SELECT query_id, chunk_id, sum(qtf * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM asked JOIN stats USING (term) JOIN post USING (term), corpus GROUP BY query_id, chunk_id),
lexical AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM scored)"""


SAVED: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The index of the documents' titles and texts: built and saved by the first query of a session, read by the others."""
    at = spark.sparkContext.applicationId, d
    if at not in SAVED:
        path = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
        title = F.concat_ws("/", "source", C("doc_id").cast("string"))
        bm25.build(table(spark, d, "documents").select(C("doc_id").alias("chunk_id"), F.concat_ws("\n", title, "text").alias("text"))).save(path)
        SAVED[at] = path
    return bm25.Index.load(spark, SAVED[at])


def _asked(spark, d):
    return table(spark, d, "benchmark").filter("item_id % 20 = 0").select(C("item_id").alias("query_id"), "text")


def _lexical(spark, d, k):
    return bm25.top_k(bm25.scores(_index(spark, d), _asked(spark, d)), k)


@query(f"WITH {SQL_BM25} SELECT chunk_id, term, tf FROM post")
def bm25_postings(spark, d):
    return _index(spark, d).postings.select("chunk_id", "term", "tf")


@query(f"WITH {SQL_BM25} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark, d):
    return _index(spark, d).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SQL_BM25} SELECT query_id, chunk_id, round(score, 5) AS score FROM scored")
def bm25_scores(spark, d):
    return bm25.scores(_index(spark, d), _asked(spark, d)).withColumn("score", F.round("score", 5))


@query(f"WITH {SQL_BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lexical WHERE rank <= 10")
def bm25_topk(spark, d):
    return _lexical(spark, d, 10).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


SQL_TITLED = SQL_BM25.replace("SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0", "SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(concat_ws('/', source, doc_id::VARCHAR)), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % 20 = 0")


@query(f"WITH {SQL_TITLED} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lexical WHERE rank <= 10")
def bm25_titles(spark, d):
    """The titles of the documents with ids divisible by 20 as queries, by blocks that can reach the first ten."""
    docs = table(spark, d, "documents").filter("doc_id % 20 = 0")
    asked = docs.select(C("doc_id").alias("query_id"), F.concat_ws("/", "source", C("doc_id").cast("string")).alias("text"))
    return bm25.search(_index(spark, d), asked, 10)[0].select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_BM25} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, chunk_id FROM lexical JOIN documents ON doc_id = chunk_id WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def bm25_filtered(spark, d):
    docs = corpus.documents(spark, d)
    passed = docs.filter(compile_filters([Filter("lang", "equals", "EN ")], "memory", docs.columns)).select(C("id").cast("long").alias("chunk_id"))
    return bm25.top_k(bm25.scores(_index(spark, d), _asked(spark, d)).join(passed, "chunk_id", "left_semi"), 10).select("query_id", "rank", "chunk_id")


# Dense search


SQL_DENSE = """dense AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""


def _query_vectors(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(C("vec_id").alias("query_id"), "embedding")


def _dense(spark, d, k, label=None):
    rows = table(spark, d, "embeddings").select(C("vec_id").alias("chunk_id"), "embedding", "label")
    return vectors.search(rows if label is None else rows.filter(C("label") == label), _query_vectors(spark, d), k)


@query(f"WITH {SQL_DENSE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM dense QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 10")
def vector_topk(spark, d):
    return _dense(spark, d, 10).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_DENSE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM dense WHERE label = 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 10")
def vector_topk_filtered(spark, d):
    return _dense(spark, d, 10, label=3).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_DENSE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM dense QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 10")
def vector_pruned(spark, d):
    """vector_topk by clusters and bounds."""
    from quarry.operators import clusters

    index = clusters.build(table(spark, d, "embeddings").select(C("vec_id").alias("chunk_id"), "embedding"))
    found, _ = clusters.search(index, _query_vectors(spark, d), 10)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS point_id, 0.0::DOUBLE AS score FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 5")
def filter_only_search(spark, d):
    return vectors.filter_only(table(spark, d, "embeddings").filter("label = 3").select(C("vec_id").alias("point_id")), 5)


# Fusion: query i is passage i and vector i


SQL_LISTS = f"""{SQL_BM25}, {SQL_DENSE}, lists AS (
  SELECT query_id, 0 AS strategy, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id FROM dense QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 25
  UNION ALL SELECT query_id, 1, rank, chunk_id FROM lexical WHERE rank <= 25),
fused AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min(strategy * 1000 + rank) AS seen FROM lists GROUP BY query_id, chunk_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen)::INTEGER AS fused_rank, chunk_id, score FROM fused)"""


def _lists(spark, d):
    one = lambda df, i: df.select("query_id", F.lit(i).alias("strategy"), "rank", "chunk_id")
    return one(_dense(spark, d, 25), 0).unionByName(one(_lexical(spark, d, 25), 1))


@query(f"WITH {SQL_LISTS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY strategy, rank)::INTEGER AS fused_rank, chunk_id, strategy FROM lists")
def identity_fusion(spark, d):
    return fusion.concatenated(_lists(spark, d)).select("query_id", "fused_rank", "chunk_id", "strategy")


@query(f"WITH {SQL_LISTS} SELECT query_id, fused_rank, chunk_id, round(score, 9) AS score FROM ranked")
def rrf_fusion(spark, d):
    return fusion.reciprocal_rank(_lists(spark, d)).select("query_id", "fused_rank", "chunk_id", F.round("score", 9).alias("score"))


def _chunks(spark, d):
    """Documents as chunks of their own."""
    docs = corpus.documents(spark, d)
    return docs.select(C("id").cast("long").alias("chunk_id"), C("id").alias("document_id"), "title", "content", "properties")


def _hybrid(spark, d, k=5):
    return fusion.reciprocal_rank(_lists(spark, d)).filter(C("fused_rank") <= k)


@query(f"WITH {SQL_LISTS} SELECT query_id, fused_rank, chunk_id, source, round(score, 9) AS score FROM ranked JOIN documents ON doc_id = chunk_id WHERE fused_rank <= 5")
def hybrid_search(spark, d):
    docs = table(spark, d, "documents").select(C("doc_id").alias("chunk_id"), "source")
    return fusion.beside(_hybrid(spark, d), docs).select("query_id", "fused_rank", "chunk_id", "source", F.round("score", 9).alias("score"))


SQL_RERANK = f"""{SQL_BM25.replace(" WHERE item_id % 20 = 0", "")}, sets AS (SELECT query_id, rank, chunk_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(t.text), '[a-z0-9]+')) AS s
  FROM lexical JOIN benchmark b ON item_id = query_id JOIN documents t ON doc_id = chunk_id WHERE rank <= 25),
overlap AS (SELECT query_id, rank, chunk_id, len(list_intersect(a, s)) / len(a) AS score FROM sets),
reranked AS (SELECT query_id, chunk_id, rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INTEGER AS new_rank FROM overlap)"""


def _reranked(spark, d, top_n=5):
    """All passages of the benchmark ask."""
    asked = table(spark, d, "benchmark").select(C("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(C("doc_id").alias("chunk_id"), C("text").alias("content"))
    lexical = bm25.top_k(bm25.scores(_index(spark, d), asked), 25)
    found = fusion.beside(lexical.join(asked.withColumnRenamed("text", "question"), "query_id"), docs)
    return fusion.rerank(found, fusion.overlap_score(C("question"), C("content")), 25, top_n)


@query(f"WITH {SQL_RERANK} SELECT query_id, new_rank, rank, chunk_id, round(score, 9) AS score FROM reranked WHERE new_rank <= 5")
def rerank_topn(spark, d):
    return _reranked(spark, d).select("query_id", "new_rank", "rank", "chunk_id", F.round("score", 9).alias("score"))


# Context, prompts and answers: user turns ask, assistant turns answer


def _answers(spark, d):
    a = table(spark, d, "conversations").filter("role = 'assistant'")
    marks = F.element_at(F.array(*map(F.lit, (" [1][2].", " [2, 1] [9].", " [3;4] [a] [ 1 ]", " none", "[0002]"))), ((C("conv_id") + C("turn")) % 5 + 1).cast("int"))
    return a.select((C("conv_id") * 100 + C("turn")).alias("query_id"), F.concat("text", marks).alias("answer"))


SQL_CITED = """answers AS (SELECT conv_id * 100 + turn AS query_id, text || [' [1][2].', ' [2, 1] [9].', ' [3;4] [a] [ 1 ]', ' none', '[0002]'][((conv_id + turn) % 5 + 1)::INTEGER] AS answer FROM conversations WHERE role = 'assistant'),
said AS (SELECT query_id, unnest([[1, 2], [2, 1, 9], [3, 4], [], [2]][((query_id // 100 + query_id % 100) % 5 + 1)::INTEGER])::INTEGER AS reference_id FROM answers)"""
SQL_SOURCES = "sources AS (SELECT DISTINCT query_id, r::INTEGER AS reference_id, 'c' || r AS chunk_id FROM answers, range(1, 4) t(r))"


def _sources(spark, d):
    three = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return _answers(spark, d).select("query_id", three.alias("reference_id")).withColumn("chunk_id", F.concat(F.lit("c"), "reference_id"))


@query(f"WITH {SQL_CITED} SELECT query_id, reference_id FROM said")
def raw_citations(spark, d):
    return _answers(spark, d).select("query_id", F.explode(context.reference_ids(C("answer"))).alias("reference_id"))


@query(f"WITH {SQL_CITED}, {SQL_SOURCES} SELECT query_id, reference_id, chunk_id FROM said JOIN sources USING (query_id, reference_id)")
def map_citations(spark, d):
    return context.citations(_answers(spark, d), _sources(spark, d)).select("query_id", "reference_id", "chunk_id")


@query(f"WITH {SQL_CITED}, {SQL_SOURCES} SELECT query_id, reference_id FROM said ANTI JOIN sources USING (query_id, reference_id)")
def dropped_citations(spark, d):
    return context.dropped(_answers(spark, d), _sources(spark, d))


# The contexts are folded a rank at a time: a source is left out if a kept one holds it or is held by it, and the first that
# passes the budget ends the list.
SQL_CONTEXT = f"""{SQL_LISTS}, best AS (SELECT query_id, fused_rank AS rank, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS pos, chunk_id, text AS content, lower({sql_collapse('text')}) AS norm, greatest(1, length(text) // 4) AS tokens FROM ranked JOIN documents ON doc_id = chunk_id WHERE fused_rank <= 5),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, 0::BIGINT AS used, false AS done, []::VARCHAR[] AS norms, []::BIGINT[] AS kept FROM best
  UNION ALL SELECT query_id, pos, CASE WHEN take THEN used + tokens ELSE used END, done OR (NOT again AND over), CASE WHEN take THEN list_append(norms, norm) ELSE norms END, CASE WHEN take THEN list_append(kept, pos) ELSE kept END
  FROM (SELECT *, NOT done AND NOT again AND NOT over AS take FROM (
    SELECT w.query_id, b.pos, used, done, norms, kept, norm, tokens, len(list_filter(norms, lambda k: contains(k, norm) OR contains(norm, k))) > 0 AS again, len(kept) > 0 AND used + tokens > 2000 AS over
    FROM walk w JOIN best b ON b.query_id = w.query_id AND b.pos = w.pos + 1))),
context AS (SELECT w.query_id, list_position(kept, b.pos)::INTEGER AS reference_id, b.rank, chunk_id, content, tokens FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1) w
  JOIN best b ON b.query_id = w.query_id AND list_contains(kept, b.pos))"""


def _context(spark, d):
    found = _hybrid(spark, d).select("query_id", C("fused_rank").alias("rank"), "chunk_id")
    return context.build_context(fusion.beside(found, _chunks(spark, d).drop("document_id")))


@query(f"WITH RECURSIVE {SQL_CONTEXT} SELECT query_id, reference_id, rank, chunk_id, content, tokens FROM context")
def context_budget(spark, d):
    return _context(spark, d).drop("title", "properties")


SYSTEM = context.template().system
SQL_PROMPT = f"""{SQL_CONTEXT}, sourced AS (SELECT query_id, string_agg('[' || reference_id || '] ' || concat_ws('/', source, doc_id::VARCHAR) || chr(10) || 'Properties:' || coalesce(chr(10) || '  lang: ' || lang, '') || coalesce(chr(10) || '  source: ' || source, '')
    || coalesce(chr(10) || '  nChars: ' || n_chars, '') || chr(10) || '  tags: ' || concat_ws(', ', lang, source) || coalesce(chr(10) || '  quality: ' || quality, '') || coalesce(chr(10) || '  toxic: ' || CASE toxic WHEN 1 THEN 'True' WHEN 0 THEN 'False' END, '')
    || chr(10) || content, chr(10) || chr(10) ORDER BY reference_id) AS sources FROM context JOIN documents ON doc_id = chunk_id LEFT JOIN labels USING (doc_id) GROUP BY query_id)"""


@query(f"WITH RECURSIVE {SQL_PROMPT} SELECT item_id AS query_id, '{SYSTEM}' AS system, 'Sources:' || chr(10) || chr(10) || coalesce(sources, '(no sources found)') || chr(10) || chr(10) || 'Question: ' || trim(text) AS user FROM benchmark LEFT JOIN sourced ON query_id = item_id WHERE item_id % 20 = 0")
def prompt_build(spark, d):
    return context.prompts(_asked(spark, d), _context(spark, d))


@query("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'The sources say so [1].' ELSE 'The sources do not answer this question.' END AS answer FROM conversations WHERE role = 'user'")
def mock_answer(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    user = F.when((C("conv_id") + C("turn")) % 3 == 0, F.concat("text", F.lit(" [1] source"))).otherwise(C("text"))
    return c.select("conv_id", "turn", context.mock_answer(user).alias("answer"))


@query(f"WITH RECURSIVE {SQL_CONTEXT} SELECT item_id AS query_id, CASE WHEN chunk_id IS NULL THEN 'The sources do not answer this question.' ELSE 'The sources say so [1].' END AS answer, coalesce('1:' || chunk_id, '') AS cited FROM benchmark LEFT JOIN context ON query_id = item_id AND reference_id = 1 WHERE item_id % 20 = 0")
def answer_pipeline(spark, d):
    """Search, context, prompt, answer by the stand-in model, citations: all queries at once."""
    sources = written(_context(spark, d), "context")
    answers = context.prompts(_asked(spark, d), sources).select("query_id", strip(context.mock_answer(C("user"))).alias("answer"))
    cited = context.citations(answers, sources).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "reference_id", "chunk_id"))).alias("c"))
    said = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["reference_id"].cast("string"), x["chunk_id"].cast("string"))), "|")
    return answers.join(cited, "query_id", "left").select("query_id", "answer", F.coalesce(said, F.lit("")).alias("cited"))


# The engine: requests with filters of their own, some without text


SQL_ENGINE = f"""{SQL_BM25}, requests AS (SELECT item_id AS query_id, text, (item_id // 20) % 2 AS filtered, 'en' AS want FROM benchmark WHERE item_id % 20 = 0 UNION ALL SELECT -1 - item_id, ' ', 1, 'de' FROM benchmark WHERE item_id % 20 = 0),
allowed AS (SELECT query_id, doc_id AS chunk_id FROM requests, documents WHERE filtered = 0 OR lang = want),
vec AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v, requests r WHERE q.vec_id = r.query_id),
lists AS (SELECT query_id, 0 AS strategy, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, chunk_id FROM vec JOIN allowed USING (query_id, chunk_id)
  UNION ALL SELECT query_id, 0, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id), chunk_id FROM allowed WHERE query_id < 0
  UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id), chunk_id FROM scored JOIN allowed USING (query_id, chunk_id)),
fused AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min(strategy * 1000 + rank) AS seen FROM lists WHERE rank <= 5 GROUP BY query_id, chunk_id)"""


@query(f"WITH {SQL_ENGINE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen)::INTEGER AS fused_rank, chunk_id, round(score, 9) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) <= 5")
def engine_search(spark, d):
    lang = lambda v: F.array(F.struct(F.lit("lang").alias("field"), F.lit("equals").alias("operator"), F.lit(v).alias("value")))
    asked = _asked(spark, d)
    spoken = asked.select("query_id", C("text").alias("semantic_query"), F.when(F.floor(C("query_id") / 20) % 2 == 1, lang("en")).otherwise(F.slice(lang("en"), 1, 0)).alias("filters"))
    blank = asked.select((-1 - C("query_id")).alias("query_id"), F.lit(" ").alias("semantic_query"), lang("de").alias("filters"))
    rows = table(spark, d, "embeddings").select(C("vec_id").alias("chunk_id"), "embedding")
    engine = Engine(_chunks(spark, d), Settings(sources=5), rows, lambda: _index(spark, d))
    return engine.search(spoken.unionByName(blank), _query_vectors(spark, d)).select("query_id", "fused_rank", "chunk_id", F.round("score", 9).alias("score"))


@query("""SELECT o_orderkey AS query_id, count(*) AS n, min(doc_id) AS least FROM orders JOIN documents ON n_chars BETWEEN o_orderkey * 7 % 3000 AND o_orderkey * 7 % 3000 + 400 AND lang IN ('en', CASE o_orderkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'es' END)
  WHERE o_orderkey % 20 = 0 GROUP BY o_orderkey""")
def filter_lists(spark, d):
    """A filter list of its own for every order whose key 20 divides (the stated query set), over all documents."""
    from quarry.operators import filter_rows

    key = C("o_orderkey")
    one = lambda field, op, kind, *values: F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), F.array(*(v.cast("string") for v in values)).alias("values"), F.lit(kind).alias("type"))
    lang = F.when(key % 3 == 0, "de").when(key % 3 == 1, "fr").otherwise("es")
    filters = F.array(one("nChars", "between", "number", key * 7 % 3000, key * 7 % 3000 + 400), one("lang", "equals", "string", F.lit("en"), lang))
    sets, asked = filter_rows.filter_sets(table(spark, d, "orders").filter(key % 20 == 0).select(key.alias("query_id"), filters.alias("filters")))
    if sets is None:
        return asked.select("query_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("least"))
    rows = corpus.documents(spark, d).select(C("id").alias("chunk_id"), "properties")
    found = filter_rows.passing(rows, sets, "index").groupBy("filter_set").agg(F.count("*").alias("n"), F.min(C("chunk_id").cast("long")).alias("least"))
    return asked.join(found, "filter_set").select("query_id", "n", "least")


@query(f"""SELECT conv_id, turn, '{{"sources":[{{"id":' || conv_id || ',"snippet":"' || left({sql_collapse('text')}, 20) || '"}}]}}' || chr(10) || text || chr(0) || '{{"citations":[' || turn || '],"generation_ms":' || (turn * 10) || '}}' AS frame FROM conversations WHERE role = 'assistant'""")
def frame_protocol(spark, d):
    from quarry.functions.text import snippet

    c = table(spark, d, "conversations").filter("role = 'assistant'")
    source = F.array(F.struct(C("conv_id").alias("id"), snippet(C("text"), 20).alias("snippet")))
    return c.select("conv_id", "turn", context.frames(source, C("text"), F.array("turn"), C("turn") * 10).alias("frame"))


STOPWORDS = ("that", "with", "from")
SQL_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_-]*')), lambda w: length(w) >= 4 AND w NOT IN ('that', 'with', 'from'))"


@query(f"""SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, s)) / len(a) END::DOUBLE AS ratio, (len(a) - len(list_intersect(a, s)))::INTEGER AS unmatched FROM (
  SELECT conv_id, turn, {SQL_TERMS.format('text')} AS a, {SQL_TERMS.format("coalesce(before, '')")} AS s, role FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)) WHERE role = 'assistant'""")
def grounding_ratio(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").withColumn("before", F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))).filter("role = 'assistant'")
    ratio, unmatched = context.grounding(C("text"), C("before"), STOPWORDS)
    return c.select("conv_id", "turn", ratio.alias("ratio"), unmatched.alias("unmatched"))


@query(None)
def embed_chunks(spark, d):
    from quarry.operators.models import embed

    return embed(table(spark, d, "documents").select(C("doc_id").alias("chunk_id"), "text"))
