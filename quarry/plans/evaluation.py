"""Queries of query understanding and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import evaluation as E
from quarry.operators import requests as R
from quarry.operators.schema import infer_schema
from quarry.plans.common import TODAY, sql_values, table, values
from quarry.sources import corpus
from quarry.storage import shared_dir

QUERIES, ORACLES = {}, {}
C = lambda c: F.col(c)


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


# Query understanding


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'notes on the ' || o_orderpriority ELSE 'any tag ' || o_orderpriority END AS semantic_query,
  CASE WHEN o_orderkey % 2 = 0 THEN 'status equals ' || o_orderstatus || '|date equals ' || strftime(o_orderdate, '%Y-%m-%d') || '|tags contains "a b"' ELSE '' END AS filters FROM orders""")
def parse_queries(spark, d):
    """Half of the queries name fields (one of them without a value, which loses its span), half name none."""
    o = table(spark, d, "orders")
    said = F.concat(F.lit(" notes  Status:  "), "o_orderstatus", F.lit(" date="), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" on the "), "o_orderpriority", F.lit(' TAG is "a b". work  win : !'))
    said = F.when(C("o_orderkey") % 2 == 0, said).otherwise(F.concat(F.lit("any tag  "), "o_orderpriority"))
    out = R.parse_queries(o.select("o_orderkey", said.alias("text")))
    return out.select("o_orderkey", "semantic_query", F.array_join(F.transform("filters", lambda f: F.concat_ws(" ", f["field"], f["operator"], f["value"])), "|").alias("filters"))


SQL_FILTERS = """filters AS (SELECT l_orderkey AS query_id, (l_linenumber % 2)::INTEGER AS source, l_partkey * 10 + l_linenumber AS pos, l_suppkey % 3 AS field FROM lineitem)"""


@query(f"""WITH {SQL_FILTERS} SELECT query_id, source, pos, field FROM filters f WHERE source = 0
  UNION ALL SELECT query_id, 1, min(pos), field FROM filters f WHERE source = 1 AND NOT EXISTS (SELECT 1 FROM filters r WHERE r.source = 0 AND r.query_id = f.query_id AND r.field = f.field) GROUP BY query_id, field""")
def merge_filters(spark, d):
    li = table(spark, d, "lineitem")
    return R.merge_filters(li.select(C("l_orderkey").alias("query_id"), (C("l_linenumber") % 2).cast("int").alias("source"), (C("l_partkey") * 10 + C("l_linenumber")).alias("pos"), (C("l_suppkey") % 3).alias("field")))


MODEL = [("q one", 'Sure: {"semantic_query": " find  it ", "filters": [{"field": "status", "operator": "=", "value": "O"}, {"field": "x", "operator": "gt", "value": "1"}], "temporal": null} ok'),
         ("q two", '{"semantic_query": "  ", "filters": [], "temporal": {"kind": "range", "unit": "week", "anchor": "last week"}}'), ("q three", "no json"), ("q four", "{broken"), ("q five", '{"filters": []}')]


@query("""SELECT conv_id, turn, [role || ' ' || conv_id, role, NULL, NULL, role][k + 1] AS semantic_query, [2, 0, NULL, NULL, 0][k + 1]::INTEGER AS n_filters, [NULL, turn || ' days ago', NULL, NULL, NULL][k + 1] AS anchor
  FROM (SELECT *, (conv_id + turn) % 5 AS k FROM conversations)""")
def parse_llm_json(spark, d):
    conv, turn = C("conv_id").cast("string"), C("turn").cast("string")
    whole = F.concat(F.lit('Sure: {"semantic_query": "  '), C("role"), F.lit("   "), conv, F.lit(' ", "filters": [{"field": "conv", "operator": "=", "value": "'), conv, F.lit('"}, {"field": "turn", "operator": "gt", "value": "1"}], "temporal": null} ok'))
    dated = F.concat(F.lit('{"semantic_query": "  ", "filters": [], "temporal": {"kind": "range", "unit": "week", "anchor": "'), turn, F.lit(' days ago"}}'))
    answer = F.element_at(F.array(whole, dated, F.lit("no json"), F.concat(F.lit("{broken "), conv), F.lit('{"filters": []}')), ((C("conv_id") + C("turn")) % 5 + 1).cast("int"))
    x = table(spark, d, "conversations").withColumn("i", R.parse_intent(answer, C("role")))
    return x.select("conv_id", "turn", "i.semantic_query", F.when(C("i").isNotNull(), F.size("i.filters")).alias("n_filters"), C("i.temporal.anchor").alias("anchor"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'status equals O|last_edited_time between a,b' ELSE 'date equals x|status equals O|last_edited_time gt y' END AS filters FROM orders")
def temporal_fold(spark, d):
    f = lambda field, op, v: F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), F.array(F.lit(v)).alias("values"))
    held = F.array(f("date", "equals", "x"), f("status", "equals", "O"), f("last_edited_time", "gt", "y"))
    bound = lambda v: F.when(C("o_orderkey") % 2 == 0, v)
    out = R.fold_temporal(held, bound("a"), bound("b"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(out, lambda x: F.concat_ws(" ", x["field"], x["operator"], F.array_join(x["values"], ","))), "|").alias("filters"))


@query("SELECT item_id, 'Schema:' || chr(10) || '{\"fields\":[]}' || chr(10) || chr(10) || 'Question: ' || text AS \"user\" FROM benchmark")
def intent_prompt(spark, d):
    system, user = R.intent_prompt(C("text"), F.lit('{"fields":[]}'), TODAY)
    return table(spark, d, "benchmark").filter(F.contains(system, F.lit(TODAY))).select("item_id", user.alias("user"))


ASKED = [(1, "status: O find", MODEL[0][1]), (2, "plain words", MODEL[0][1]), (3, "plain words", None), (4, "tags: a b", "no json"), (5, "what happened last week", MODEL[1][1]),
         (6, "spent", '{"semantic_query": "spent", "filters": [{"field": "price", "operator": ">=", "value": "12.5"}, {"field": "price", "operator": "=", "value": "1"}, {"field": "open", "operator": "=", "value": "maybe"}]}')]


@query("""SELECT * FROM (VALUES (1, 'find it', 'status equals O find'), (2, 'find it', 'status equals O'), (3, 'plain words', ''), (4, '', 'tags contains a b'),
  (5, 'what happened last week', 'last_edited_time between 2024-02-19T00:00:00+00:00,2024-02-25T23:59:59.999999+00:00'), (6, 'spent', 'price gte 12.5')) t(query_id, semantic_query, filters) WHERE (SELECT count(*) FROM orders) > 0""")
def intent_apply(spark, d):
    """Rule and model filters of a few questions, validated by the orders' schema."""
    asked = values(spark, "query_id int, text string, answer string", ASKED)
    out = R.analyze(asked.select("query_id", "text"), asked.select("query_id", "answer"), schema=infer_schema(corpus.orders(spark, d)), today=TODAY)
    return out.withColumn("filters", F.array_join(F.transform("filters", lambda f: F.concat_ws(" ", f["field"], f["operator"], F.array_join(f["values"], ","))), "|"))


# Evaluation: customers as cases, their orders as results of two modes


SQL_EVAL = """cases AS (SELECT c_custkey AS case_id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END AS category,
    CASE WHEN c_custkey % 4 = 0 THEN [] ELSE [c_custkey % 20, (c_custkey + 7) % 20] END AS expected FROM customer),
raw AS (SELECT 'a' AS mode, o_custkey AS case_id, o_orderkey AS chunk_id, o_orderkey % 20 AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
  UNION ALL SELECT 'b', o_custkey, o_orderkey, o_orderkey % 20, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders),
ranked AS (SELECT mode, case_id, chunk_id, document_id, rank::INTEGER AS rank FROM raw WHERE rank <= 12),
docs AS (SELECT mode, case_id, document_id, row_number() OVER (PARTITION BY mode, case_id ORDER BY min(rank))::INTEGER AS doc_rank FROM ranked GROUP BY mode, case_id, document_id),
hits AS (SELECT d.mode, d.case_id, min(doc_rank) AS first_rank, count_if(doc_rank <= 5) AS n5, count_if(doc_rank <= 10) AS n10 FROM docs d JOIN cases c ON c.case_id = d.case_id AND list_contains(expected, document_id) GROUP BY ALL),
judged AS (SELECT m.mode, c.case_id, coalesce(nullif(trim(category), ''), 'uncategorized') AS category, len(expected) > 0 AS has_expectation, first_rank,
    CASE WHEN len(expected) > 0 THEN coalesce(n5, 0) / len(expected) END AS found_5, CASE WHEN len(expected) > 0 THEN coalesce(n10, 0) / len(expected) END AS found_10
  FROM cases c CROSS JOIN (VALUES ('a'), ('b')) m(mode) LEFT JOIN hits h ON h.mode = m.mode AND h.case_id = c.case_id)"""
SQL_METRICS = "count(*) AS cases, round(coalesce(avg(found_5), 0), 9) AS recall_5, round(coalesce(avg(found_10), 0), 9) AS recall_10, round(coalesce(avg(CASE WHEN has_expectation THEN coalesce(1 / first_rank, 0) END), 0), 9) AS mrr"


def _cases(spark, d):
    c = table(spark, d, "customer")
    category = F.when(C("c_custkey") % 5 == 1, " ").when(C("c_custkey") % 5 > 1, C("c_mktsegment"))
    expected = F.when(C("c_custkey") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(C("c_custkey") % 20, (C("c_custkey") + 7) % 20))
    return c.select(C("c_custkey").alias("case_id"), category.alias("category"), expected.alias("expected"))


def _ranked(spark, d):
    o = table(spark, d, "orders")
    one = lambda mode, *order: o.select(F.lit(mode).alias("mode"), C("o_custkey").alias("case_id"), C("o_orderkey").alias("chunk_id"), (C("o_orderkey") % 20).alias("document_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy(*order)).alias("rank"))
    return one("a", F.desc("o_totalprice"), "o_orderkey").unionByName(one("b", "o_orderdate", "o_orderkey")).filter("rank <= 12")


def _judged(spark, d):
    return E.per_case(_cases(spark, d), _ranked(spark, d), ["a", "b"])


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {SQL_EVAL} SELECT mode, case_id, document_id, doc_rank FROM docs")
def eval_doc_ranking(spark, d):
    return E.document_ranking(_ranked(spark, d)).select("mode", "case_id", "document_id", "doc_rank")


@query(f"WITH {SQL_EVAL} SELECT mode, case_id, first_rank FROM judged")
def eval_first_rank(spark, d):
    return _judged(spark, d).select("mode", "case_id", "first_rank")


@query(f"WITH {SQL_EVAL} SELECT mode, {SQL_METRICS} FROM judged GROUP BY mode")
def eval_recall(spark, d):
    return _rounded(E.metrics(_judged(spark, d), "mode"))


@query(f"WITH {SQL_EVAL} SELECT mode, mrr FROM (SELECT mode, {SQL_METRICS} FROM judged GROUP BY mode)")
def eval_mrr(spark, d):
    return _rounded(E.metrics(_judged(spark, d), "mode")).select("mode", "mrr")


@query(f"WITH {SQL_EVAL} SELECT mode, category, {SQL_METRICS} FROM judged GROUP BY mode, category UNION ALL SELECT mode, 'overall', {SQL_METRICS} FROM judged GROUP BY mode")
def eval_by_category(spark, d):
    return _rounded(E.by_category(_judged(spark, d)))


@query(f"WITH {SQL_EVAL}, m AS (SELECT mode, {SQL_METRICS} FROM judged GROUP BY mode) SELECT m.mode, round(m.recall_5 - b.recall_5, 6) AS delta_recall_5, round(m.recall_10 - b.recall_10, 6) AS delta_recall_10, round(m.mrr - b.mrr, 6) AS delta_mrr FROM m, m b WHERE b.mode = 'a'")
def eval_deltas(spark, d):
    out = E.deltas(E.metrics(_judged(spark, d), "mode"), "a")
    return out.select("mode", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"WITH {SQL_EVAL} SELECT category, round(coalesce(avg(found_5) FILTER (mode = 'a'), 0), 9) AS a, round(coalesce(avg(found_5) FILTER (mode = 'b'), 0), 9) AS b FROM judged GROUP BY category")
def eval_pivot(spark, d):
    return _rounded(_judged(spark, d).groupBy("category").pivot("mode", ["a", "b"]).agg(F.coalesce(F.avg("found_5"), F.lit(0.0))))


@query("SELECT event_type AS stage, round(avg(value), 6) AS mean_ms, count(*) AS n FROM events GROUP BY event_type")
def timing_avg(spark, d):
    return table(spark, d, "events").groupBy(C("event_type").alias("stage")).agg(F.round(F.avg("value"), 6).alias("mean_ms"), F.count("*").alias("n"))


@query(f"WITH {SQL_EVAL} SELECT x.case_id, x.chunk_id, x.rank, CASE WHEN y.rank IS NULL THEN 'new' WHEN y.rank > x.rank THEN 'up ' || (y.rank - x.rank) WHEN y.rank < x.rank THEN 'down ' || (x.rank - y.rank) ELSE 'same' END AS move FROM ranked x LEFT JOIN ranked y ON y.mode = 'a' AND y.case_id = x.case_id AND y.chunk_id = x.chunk_id WHERE x.mode = 'b' AND x.rank <= 5")
def rerank_movement(spark, d):
    r = _ranked(spark, d)
    return E.movement(r.filter("mode = 'a'"), r.filter("mode = 'b' AND rank <= 5"))


@query(f"WITH {SQL_EVAL} SELECT mode, count(*) - count_if(first_rank <= 5)::BIGINT AS failed, count_if(first_rank > 5)::BIGINT AS outside, count_if(first_rank IS NULL)::BIGINT AS not_found FROM judged WHERE has_expectation GROUP BY mode")
def eval_highlights(spark, d):
    return E.highlights(_judged(spark, d))


@query(f"WITH {SQL_EVAL} SELECT mode, r.case_id, rank, chunk_id, CASE WHEN list_contains(expected, document_id) THEN 'HIT' ELSE 'miss' END AS mark FROM ranked r JOIN cases USING (case_id) WHERE rank <= 5")
def eval_diagnostics(spark, d):
    both = _ranked(spark, d).filter("rank <= 5").join(_cases(spark, d), "case_id")
    return both.select("mode", "case_id", "rank", "chunk_id", F.when(F.array_contains("expected", C("document_id")), "HIT").otherwise("miss").alias("mark"))


@query("""WITH ranked AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
firsts AS (SELECT query_id, min(rank) FILTER (p_name IN ('red widget', 'small ring')) AS r FROM ranked WHERE rank <= 3 GROUP BY query_id) SELECT count(*) AS queries, count(r) / count(*) AS hit_3, round(avg(coalesce(1 / r, 0)), 9) AS mrr FROM firsts""")
def title_hit_at_k(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), C("p_partkey") == C("l_partkey"))
    ranked = li.select(C("l_orderkey").alias("query_id"), "p_name", F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")).alias("rank")).filter("rank <= 3")
    first = ranked.groupBy("query_id").agg(F.min(F.when(C("p_name").isin("red widget", "small ring"), C("rank"))).alias("r"))
    return first.agg(F.count("*").alias("queries"), (F.count("r") / F.count("*")).alias("hit_3"), F.round(F.avg(F.coalesce(1 / C("r"), F.lit(0.0))), 9).alias("mrr"))


# Cases from the corpus: customers as documents, their orders as chunks


SQL_CORPUS = """chunks AS (SELECT o_custkey AS document_id, c_mktsegment || ' ' || (c_custkey // 3) AS document_title, o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS chunk_index FROM orders JOIN customer ON c_custkey = o_custkey),
docs AS (SELECT document_id, min(document_title) AS title, array_agg(chunk_id ORDER BY chunk_index) AS chunk_ids FROM chunks GROUP BY document_id),
idx AS (SELECT field, value, array_agg(document_id ORDER BY document_id) AS documents FROM (SELECT DISTINCT document_id, unnest(['status', 'tags', 'tags']) AS field, unnest(['s' || (document_id % 300), title, ' ']) AS value FROM docs) WHERE trim(value) <> '' GROUP BY field, value HAVING count(*) <= 8),
uniq AS (SELECT * FROM docs QUALIFY count(*) OVER (PARTITION BY lower(trim(title))) = 1 AND length(trim(title)) >= 6)"""


def _corpus_docs(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), C("c_custkey") == C("o_custkey"))
    index = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    title = F.concat("c_mktsegment", F.lit(" "), F.floor(C("c_custkey") / 3).cast("string"))
    return E.corpus_documents(o.select(C("o_custkey").alias("document_id"), title.alias("document_title"), C("o_orderkey").alias("chunk_id"), index.alias("chunk_index")))


def _value_index(spark, d):
    docs = _corpus_docs(spark, d)
    status = corpus.string_value(F.concat(F.lit("s"), (C("document_id") % 300).cast("string")))
    rows = docs.select("document_id", corpus.properties(status=status, tags=corpus.list_value(F.array("title", F.lit(" "))), other=status).alias("properties"))
    return E.value_index(corpus.property_rows(rows, "document_id"), ("category", "leetcodeTopic", "status", "project", "team", "tags"))


@query(f"WITH {SQL_CORPUS} SELECT document_id, title, array_to_string(chunk_ids, ',') AS chunk_ids FROM docs")
def corpus_docs(spark, d):
    return _corpus_docs(spark, d).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"WITH {SQL_CORPUS} SELECT field, value, array_to_string(documents, ',') AS documents FROM idx")
def value_index(spark, d):
    return _value_index(spark, d).withColumn("documents", F.array_join("documents", ","))


@query(f"WITH {SQL_CORPUS} SELECT document_id, title FROM uniq")
def unique_titles(spark, d):
    return E.unique_titles(_corpus_docs(spark, d)).select("document_id", "title")


SQL_CASES = f"""{SQL_CORPUS}, pairs AS (SELECT *, row_number() OVER (ORDER BY field, value) AS nth, (SELECT array_to_string(flatten(array_agg(chunk_ids ORDER BY document_id)), ',') FROM docs WHERE list_contains(documents, document_id)) AS chunks FROM (SELECT * FROM idx ORDER BY field, value LIMIT 8)),
titled AS (SELECT *, 'd-' || lower(replace(title, ' ', '-')) AS s FROM (SELECT * FROM uniq ORDER BY len(chunk_ids) DESC, lower(title) LIMIT 6)),
tailed AS (SELECT *, field || '-' || lower(array_to_string(regexp_extract_all(value, '[A-Za-z0-9]+'), '-')) AS tail FROM pairs),
made AS (SELECT 'metadata-' || tail AS id, field || ': ' || value AS query, 'metadata' AS category, array_to_string(documents, ',') AS documents, chunks FROM tailed
  UNION ALL SELECT left('keyword-' || s[3:], 60), title, 'keyword', document_id::VARCHAR, array_to_string(chunk_ids, ',') FROM titled
  UNION ALL SELECT left('semantic-' || s[3:], 60), 'What do my notes say about ' || title || '?', 'semantic', document_id::VARCHAR, array_to_string(chunk_ids, ',') FROM titled
  UNION ALL SELECT 'hybrid-' || tail, 'what did I work on ' || field || ': ' || value, 'hybrid', array_to_string(documents, ','), chunks FROM tailed WHERE nth <= 4)"""


def _made(spark, d):
    return E.generate_cases(_value_index(spark, d), _corpus_docs(spark, d))


@query(f"WITH {SQL_CASES} SELECT * FROM made")
def generate_cases(spark, d):
    return _made(spark, d).select("id", "query", "category", F.array_join("expected_documents", ",").alias("documents"), F.array_join("expected_chunks", ",").alias("chunks"))


@query(f"WITH {SQL_CASES} SELECT category, count(*) AS n FROM made GROUP BY category")
def case_counts(spark, d):
    return _made(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT 'case-' || item_id AS id, text AS query, NULL::VARCHAR AS category, 0 AS expected FROM benchmark")
def eval_cases_scan(spark, d):
    """The benchmark's passages written as a case file and read back."""
    b = table(spark, d, "benchmark")
    cases = b.select(F.concat(F.lit("case-"), "item_id").alias("id"), C("text").alias("query"), F.lit(None).cast("string").alias("category"), *(F.array().cast("array<string>").alias(c) for c in ("expected_documents", "expected_chunks")))
    path = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    E.write_cases(cases, path)
    return E.read_cases(spark, path, lines=True).select("id", "query", "category", F.size("expected_documents").alias("expected"))
