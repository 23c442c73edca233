"""Quirks of the rules on small literal tables."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import text as X
from quarry.operators import bm25, columns, context, evaluation, filter_rows, fusion, models, requests, roles, schema, sync, vectors
from quarry.operators.engine import Engine, build_engine
from quarry.operators.predicates import Filter, compile_filters
from quarry.operators.requests import Field
from quarry.plans import drivers
from quarry.sources import corpus, listing, pages
from tests.compare import same_as_sql


@pytest.fixture(scope="module")
def stored(spark):
    row = spark.range(1).select(
        F.lit("2024-03-04T23:30:00Z").alias("last_edited_time"),
        corpus.properties(
            flag=corpus.flag_value(F.lit(True)), number=corpus.whole_value(F.lit(133)), name=corpus.string_value(F.lit("Ab c")), tags=corpus.list_value(F.array(F.lit("X"), F.lit("2024-01-02"))),
            day=corpus.string_value(F.lit("2024-05-06")), none=corpus.string_value(F.lit(None).cast("string")),
        ).alias("properties"),
    )
    return row.cache()


@pytest.mark.parametrize(
    ("f", "index", "memory"),
    [
        (Filter("flag", "equals", "true"), False, True),
        (Filter("flag", "equals", True), True, True),
        (Filter("number", "equals", "133"), False, True),
        (Filter("number", "equals", 133), True, True),
        (Filter("name", "equals", " ab C "), False, True),
        (Filter("name", "contains", "Ab"), False, False),
        (Filter("tags", "contains", "X"), True, True),
        (Filter("tags", "equals", ["y", "x"]), False, True),
        (Filter("tags", "gt", "2024-01-01"), True, False),
        (Filter("number", "between", [100, 133]), True, True),
        (Filter("day", "between", ["2024-05-06", "2024-05-06"]), True, True),
        (Filter("last_edited_time", "lte", "2024-03-04"), False, True),
        (Filter("last_edited_time", "gt", "2024-03-04T23:00:00Z"), True, False),
        (Filter("created_time", "gt", "1990-01-01"), False, False),
        (Filter("none", "equals", ""), False, False),
        (Filter("absent", "equals", "x"), False, False),
    ],
)
def test_evaluators_differ_as_stated(stored, f, index, memory):
    passes = lambda mode: stored.filter(compile_filters([f], mode, stored.columns)).count() == 1
    assert (passes("index"), passes("memory")) == (index, memory)


@pytest.mark.parametrize(
    "f",
    [Filter(field, op, v) for field in ("flag", "number", "name", "tags", "day", "mixed", "none") for op, v in (
        ("equals", "true"), ("equals", True), ("equals", 133), ("equals", "133"), ("contains", ["x", "Ab c", "X"]), ("equals", " ab C "), ("gt", "2024-01-01"), ("lte", "2024-05-06"),
        ("between", ["2024-01-01", "2024-12-31"]), ("gt", "2024-05-06T01:00:00+05:00"), ("gte", 1), ("lt", "200"), ("between", [100, 133]), ("between", ["20240101", "20250101"]), ("equals", []))],
)
def test_typed_columns_agree_with_the_map(many, f):
    wide, names = many
    for mode in ("index", "memory"):
        by = lambda columns, f=f, mode=mode: sorted(r["i"] for r in wide.filter(compile_filters([f], mode, columns)).select("i").collect())
        assert by(wide.columns) == by([c for c in wide.columns if c not in names])


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Rows with properties of all kinds, one of them mixed, and their typed columns."""
    c, at = F.col, str(tmp_path_factory.mktemp("typed") / "t")
    rows = spark.range(40).select(c("id").alias("i"), corpus.properties(
        flag=corpus.flag_value(F.when(c("id") % 3 > 0, c("id") % 2 == 0)), number=corpus.whole_value(c("id") * 19), name=corpus.string_value(F.when(c("id") % 4 == 0, "Ab c").when(c("id") % 4 == 1, " AB C").otherwise(c("id").cast("string"))),
        tags=corpus.list_value(F.when(c("id") % 2 == 0, F.array(F.lit("X"), F.lit("2024-01-02")))), day=corpus.string_value(F.when(c("id") % 5 > 0, F.concat(F.lit("2024-05-0"), (c("id") % 9 + 1).cast("string"), F.when(c("id") % 2 == 0, "T03:00:00Z").otherwise("")))),
        mixed=F.when(c("id") % 4 == 0, corpus.string_value(F.lit("133"))).when(c("id") % 4 == 1, corpus.whole_value(c("id") * 7)).when(c("id") % 4 == 2, corpus.string_value(F.lit("2024-05-06"))).otherwise(corpus.flag_value(F.lit(True))),
    ).alias("properties"))
    names = columns.wanted(schema.seen(rows))
    columns.write(rows, names, at)
    return spark.read.parquet(at).cache(), names


def test_typed_filters_reach_the_scan(spark, tmp_path):
    rows = corpus.orders(spark, "/root/testdata/sf0.001")
    names = columns.wanted(schema.seen(rows))
    columns.write(rows, names, str(tmp_path / "o"))
    wide = spark.read.parquet(str(tmp_path / "o"))
    pushed = lambda mode, f: wide.filter(compile_filters([f], mode, wide.columns)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    for mode, f, part in (("index", Filter("price", "gt", 250000), "GreaterThan(price__num,250000.0)"), ("memory", Filter("priority", "equals", ["1-URGENT", "x"]), "In(priority__norm"), ("memory", Filter("orderDate", "between", ["1997-01-01", "1997-12-31"]), "GreaterThanOrEqual(orderDate__day,1997-01-01)"), ("index", Filter("open", "equals", True), "open__flag")):
        plan = pushed(mode, f)
        assert part in plan.split("PushedFilters: ")[1].split("ReadSchema")[0] and "properties" not in plan.split("ReadSchema: ")[1]


def test_filters_as_data_agree_with_conditions(spark, stored, many):
    """Each filter of the two tests above as the list of a request, and lists of several; one plan for all of them."""
    said = [
        ("flag", "equals", ["true"], "boolean"), ("flag", "equals", ["true"], "string"), ("number", "equals", ["133"], "number"), ("number", "equals", ["133"], "string"), ("name", "equals", [" ab C "], "string"),
        ("name", "contains", ["Ab"], "string"), ("tags", "contains", ["X"], "string"), ("tags", "equals", ["y", "x"], "string"), ("tags", "gt", ["2024-01-01"], "string"), ("number", "between", ["100", "133"], "number"),
        ("day", "between", ["2024-05-06", "2024-05-06"], "string"), ("last_edited_time", "lte", ["2024-03-04"], "string"), ("last_edited_time", "gt", ["2024-03-04T23:00:00Z"], "string"), ("created_time", "gt", ["1990-01-01"], "string"),
        ("none", "equals", [""], "string"), ("absent", "equals", ["x"], "string"), ("number", "lt", ["133.5"], "number"), ("number", "gte", ["0"], "number"), ("day", "gt", ["2024-01-01"], "string"),
    ]
    lists = [[f] for f in said] + [[f, g] for f in said[:10] for g in said[9:]] + [[]]
    kind = "query_id long, filters array<struct<field:string,operator:string,values:array<string>,type:string>>"
    sets, asked = filter_rows.filter_sets(spark.createDataFrame(list(enumerate(lists)), kind))
    of = {r["query_id"]: r["filter_set"] for r in asked.collect()}
    assert of[len(lists) - 1] == -1 and len(set(of.values())) == len({json.dumps(x) for x in lists})
    for rows in (stored, many[0]):
        rows = rows.select("*", F.monotonically_increasing_id().alias("chunk_id"))
        for mode in ("index", "memory"):
            got = {(r["filter_set"], r["chunk_id"]) for r in filter_rows.passing(rows, sets, mode).collect()}
            names = ("field", "operator", "values", "type")
            conditions = [compile_filters([filter_rows.parsed(dict(zip(names, f, strict=True))) for f in x], mode, [c for c in rows.columns if columns.SEP not in c]) for x in lists[:-1]]
            held = rows.select("chunk_id", F.array(*conditions).alias("c")).collect()
            assert got == {(of[q], r["chunk_id"]) for r in held for q, c in enumerate(r["c"]) if c}
    bad, _ = filter_rows.filter_sets(spark.createDataFrame([(1, [("number", "gt", ["x"], "string")])], kind))
    with pytest.raises(Exception, match="not numeric"):
        filter_rows.passing(rows, bad, "index").collect()


def test_malformed_ranges(stored):
    bad = Filter("number", "between", [1])
    assert stored.filter(compile_filters([bad], "memory", stored.columns)).count() == 0
    for f in (bad, Filter("number", "gt", "x"), Filter("number", "gt", True)):
        with pytest.raises(ValueError):
            compile_filters([f], "index", stored.columns)
    assert stored.filter(compile_filters([], "index", stored.columns)).count() == 1


def test_point_ids_are_version_five(spark):
    ids = [f"doc-{i}é_{i}" for i in range(50)]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", X.point_id(F.col("i")).alias("p")).collect()
    assert all(r["p"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["i"])) for r in got)


def test_fusion_ties_keep_first_sight(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 1, 3, "c")]
    got = fusion.reciprocal_rank(spark.createDataFrame(rows, "query_id int, strategy int, rank int, chunk_id string")).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank(got, 0)


def test_bm25_matches_by_shared_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat the"), (2, "the dog"), (3, "the"), (4, None)], "chunk_id long, text string")
    index = bm25.build(docs)
    asked = spark.createDataFrame([(1, "the the Unknown"), (2, "zzz"), (3, "")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25.scores(index, asked).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3)}
    index.save(str(tmp_path / "i"))
    again = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25.scores(bm25.Index.load(spark, str(tmp_path / "i")), asked).collect()}
    assert again == pytest.approx(got)
    with pytest.raises(ValueError):
        bm25.build(docs.limit(0)).save(str(tmp_path / "e"))


def test_vector_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(7)
    asked = spark.createDataFrame([(*r, -1) for r in rows[:3]] + [(9, rows[0][1], 0)], "query_id long, embedding array<double>, filter_set int")
    found = vectors.search(table.withColumn("passed", F.expr("CASE WHEN chunk_id % 2 = 1 THEN array(0L) END")), asked, 4, most_bytes=100).collect()
    assert len(found) == 16 and all(r["chunk_id"] % 2 for r in found if r["query_id"] == 9)
    m = np.array([v for _, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        v = np.array(rows[q][1])
        best = np.argsort(-(m @ (v / np.linalg.norm(v))))[:4]
        assert [r["chunk_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == best.tolist()
    with pytest.raises(ValueError):
        vectors.search(None, None, 0)


def test_a_task_of_vector_search_holds_few_scores(spark):
    """4,000 queries against a batch of 10,000 vectors: what a task holds stays far under a block of 1,024 by 10,000 scores."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(10_000, 8)), vectors._unit(rng.normal(size=(4000, 8)))
    batch = pa.record_batch([pa.array(np.arange(10_000)), pa.array(rows.tolist()), pa.array([[]] * 10_000, pa.list_(pa.int64()))], ["chunk_id", "embedding", "passed"])
    sent = SimpleNamespace(value=(list(range(4000)), np.full(4000, -1), asked))
    tracemalloc.start()
    found = pa.Table.from_batches(vectors.best_of(sent, 10, vectors._blocks)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 40_000 and most < 64 << 20


def test_texts_that_nobody_found_do_not_move(spark):
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.lit("text").alias("content"), F.create_map(F.lit("a"), F.lit("b")).alias("properties"))
    found = spark.createDataFrame([(1, 7, 0.5, 1), (1, 9, 0.4, 2)], "query_id long, chunk_id long, score double, fused_rank int")
    asked = spark.createDataFrame([(1, "text")], "query_id long, semantic_query string")
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = Engine(chunks, Settings(rerank=False)).ranked(found, asked)
        assert "hashpartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()
        assert {r["chunk_id"] for r in ranked.collect()} == {7, 9}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)


def test_a_context_computes_its_search_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "query_id int, rank int, chunk_id string, content string"
    ranked = spark.createDataFrame([(1, 1, "a", "one"), (1, 2, "b", "two")], kind).mapInArrow(count, kind)
    assert context.build_context(ranked).count() == 2
    assert seen.value == 2


def test_context_stops_at_the_budget(spark):
    rows = [(1, 1, "a", "x" * 100), (1, 2, "b", "X" * 50), (1, 3, "c", "y" * 40), (1, 4, "d", "z" * 4), (2, 1, "e", "long" * 100)]
    got = context.build_context(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, content string"), budget=30).collect()
    assert sorted((r["query_id"], r["reference_id"], r["chunk_id"]) for r in got) == [(1, 1, "a"), (2, 1, "e")]
    more = context.build_context(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, content string"), budget=36).collect()
    assert [r["chunk_id"] for r in sorted(more, key=lambda r: r["rank"]) if r["query_id"] == 1] == ["a", "c", "d"]


def test_reference_ids(spark):
    said = ["[1][2]", "[1, 2]", "[3;4]", "[9] [a] [9]", "", None]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(context.reference_ids(F.col("s")).alias("r")).collect()
    assert [r["r"] for r in got] == [[1, 2], [1, 2], [3, 4], [9, 9], [], None]


def test_empty_question_is_refused(spark):
    ctx = spark.createDataFrame([], "query_id int, reference_id int, content string")
    with pytest.raises(Exception, match="question is empty"):
        context.prompts(spark.createDataFrame([(1, "  ")], "query_id int, text string"), ctx).collect()


def test_rule_parser(spark):
    cases = {
        "what did I learn about docker networking": ("what did I learn about docker networking", []),
        "status: In Progress": ("", [("status", "equals", "In Progress")]),
        "deployment notes status: In Progress": ("deployment notes", [("status", "equals", "In Progress")]),
        "retro leetcode topic: Graphs project: Atlas team: AI tag: RAG": ("retro", [("leetcodeTopic", "equals", "Graphs"), ("project", "equals", "Atlas"), ("team", "equals", "AI"), ("tags", "contains", "RAG")]),
        "priority: high urgent tasks": ("priority: high urgent tasks", []),
        "what did I do on date: 21-07-2026": ("what did I do on", [("date", "equals", "2026-07-21")]),
        "team is 'A B'": ("", [("team", "equals", "A B")]),
        'see status: "x". ': ("see", [("status", "equals", '"x"')]),
        "lost date: tomorrow": ("lost", []),
    }
    got = requests.parse_queries(spark.createDataFrame([(q,) for q in cases], "text string")).collect()
    assert {r["text"]: (r["semantic_query"], [tuple(f) for f in r["filters"]]) for r in got} == cases


def test_metrics_on_hand_cases(spark):
    cases = spark.createDataFrame([(i, None, ["d"]) for i in range(4)] + [(9, "x", [])], "case_id int, category string, expected array<string>")
    at = {0: 1, 1: 3, 2: 8}
    rows = [("m", c, r, f"{c}{r}", "d" if at.get(c) == r else f"o{r}") for c in range(4) for r in range(1, 11)]
    judged = evaluation.per_case(cases, spark.createDataFrame(rows, "mode string, case_id int, rank int, chunk_id string, document_id string"), ["m"])
    r = evaluation.metrics(judged, "mode").first()
    assert (r["cases"], r["recall_5"], r["recall_10"]) == (5, 0.5, 0.75) and r["mrr"] == pytest.approx((1 + 1 / 3 + 1 / 8) / 4)
    assert "0.7500" in evaluation.table_text(evaluation.metrics(judged, "mode")) and evaluation.table_text(judged, markdown=True).startswith("| mode")


def test_case_files_are_checked(spark, tmp_path):
    def read(rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(rows))
        return evaluation.read_cases(spark, str(path)).collect()

    assert read([{"id": "a", "query": "q", "note": 1}])[0]["expected_documents"] == []
    for bad in ([{"id": "a", "query": " "}], [{"id": "a", "query": "q"}] * 2):
        with pytest.raises(Exception, match="case"):
            read(bad)


def test_points_need_their_values(spark):
    rows = spark.createDataFrame([("c", None, "t", "x")], "chunk_id string, document_id string, document_title string, content string")
    with pytest.raises(Exception, match="lacks a required value"):
        sync.checked_points(rows).collect()


def test_engine_modes(spark):
    chunks = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(["red cat", "blue cat", "green dog", "cat"])], "chunk_id long, content string, document_id string").withColumn(
        "properties", corpus.properties(kind=corpus.string_value(F.when(F.col("chunk_id") < 2, "Pet").otherwise("x")))
    )
    embedded = models.embed(chunks.withColumnRenamed("content", "text")).cache()
    index = bm25.build(chunks.withColumnRenamed("content", "text"))
    asked = spark.createDataFrame([(1, "red cat")], "query_id long, text string")
    for mode in ("vector", "bm25", "hybrid"):
        for rerank in (False, True):
            got = Engine(chunks, Settings(mode=mode, rerank=rerank), embedded, lambda: index).ask(asked).orderBy("fused_rank").collect()
            assert got[0]["chunk_id"] == 0 and len(got) <= 5
    kind = Field("kind", ("kind",))
    engine = Engine(chunks, Settings(), embedded, index, lambda q: requests.parse_queries(q, (kind,)))
    both = engine.ask(spark.createDataFrame([(1, "red cat kind: Pet"), (2, "red cat"), (3, "kind: x")], "query_id long, text string")).collect()
    of = lambda q: [r["chunk_id"] for r in sorted(both, key=lambda r: r["fused_rank"]) if r["query_id"] == q]
    assert set(of(1)) == {0, 1} and of(2)[0] == 0 and len(of(2)) == 4 and of(3) == [2, 3]
    with pytest.raises(ValueError):
        Settings(mode="other")
    assert Settings.of(" BM25 ").mode == "bm25" and len(Settings(zone="No/Where").today()) == 10


def test_built_engine_asks_a_model_only_with_a_schema(spark):
    chunks = spark.createDataFrame([(1, "red cat", "1"), (2, "red dog", "2")], "chunk_id long, content string, document_id string").withColumn("properties", corpus.properties(kind=corpus.string_value(F.col("content"))))
    schema_ = schema.infer_schema(chunks)
    intent = lambda q: models.answer(q.select("query_id", F.lit("s").alias("system"), F.col("text").alias("user")), lambda s, u, how: '{"semantic_query": "dog", "filters": [{"field": "kind", "operator": "=", "value": "red dog"}]}', models.INTENT)
    asked = spark.createDataFrame([(1, "which animal")], "query_id long, text string")
    index = bm25.build(chunks.withColumnRenamed("content", "text"))
    for settings, expected in ((Settings(mode="bm25", intent=True), [2]), (Settings(mode="bm25"), [])):
        engine = build_engine(chunks, settings, index=index, fields=schema_.select("name", "multi"), schema=schema_, intent=intent)
        assert [r["chunk_id"] for r in engine.ask(asked).collect()] == expected


def test_drivers(spark):
    texts = ["red cat", "blue cat", "green dog", "old tree"]
    chunks = spark.createDataFrame([(i, t, f"d{i}", f"Title {i}") for i, t in enumerate(texts)], "chunk_id long, content string, document_id string, title string").withColumn("properties", corpus.properties(kind=corpus.string_value(F.lit("k"))))
    engine = Engine(chunks, Settings(), models.embed(chunks.withColumnRenamed("content", "text")).cache(), bm25.build(chunks.withColumnRenamed("content", "text")))
    cases = spark.createDataFrame([(1, "red cat", "easy", ["d0"]), (2, "old tree", None, ["d3"])], "case_id long, query string, category string, expected array<string>")
    judged, timings, said = drivers.pipeline_comparison(engine, cases, depth=3)
    assert {r["mode"] for r in judged.collect()} == {"vector", "bm25", "hybrid", "hybrid_reranked"} and all(r["first_rank"] == 1 for r in judged.collect())
    assert {r["stage"] for r in timings.collect()} == {"analysis", "filters", "vector", "bm25", "fusion", "rerank", "sources", "total"}
    for mode in ("vector", "hybrid_reranked"):
        took = {r["stage"]: r["ms"] for r in timings.collect() if r["mode"] == mode}
        assert abs(sum(took.values()) - 2 * took["total"]) < 0.1 * took["total"]
    assert "[PASS] hybrid 1 (easy)" in said and "avg_latency_ms" in said
    _, _, moved = drivers.intent_comparison(engine, engine, cases, depth=3)
    assert "delta_mrr" in moved and "vector" in drivers.vector_evaluation(engine, cases)[2]
    answers, said = drivers.generation_evaluation(engine, cases.select(F.col("case_id").alias("query_id"), F.col("query").alias("text")))
    assert [[c["chunk_id"] for c in r["citations"]] for r in answers.orderBy("query_id").collect()] == [[0], [3]]
    assert "**Title 0**: red cat" in said and "- citations: [1]" in said


def test_prompts_show_titles_and_properties(spark):
    rows = spark.createDataFrame([(1, 1, "red cat", "T")], "query_id int, reference_id int, content string, title string").withColumn("properties", corpus.properties(kind=corpus.string_value(F.lit("Pet")), tags=corpus.list_value(F.array(F.lit("a"), F.lit("b"))), n=corpus.whole_value(F.lit(3))))
    user = context.prompts(spark.createDataFrame([(1, " q ")], "query_id int, text string"), rows).first()["user"]
    assert user == "Sources:\n\n[1] T\nProperties:\n  kind: Pet\n  tags: a, b\n  n: 3\nred cat\n\nQuestion: q"
    assert context.template(" Grounded ") is context.TEMPLATES["grounded"]
    with pytest.raises(ValueError, match="there are: grounded"):
        context.template("other")


def test_model_backends():
    broken = lambda texts: 1 / 0
    assert models.with_fallback(broken, models.hashed_tokens)(["a"]).shape == (1, 64)
    with pytest.raises(RuntimeError):
        models.with_fallback(broken, lambda texts: [])(["a"])
    assert models.backend(" Mock ")("", "[1] x", models.ANSWER).endswith("[1].") and models.INTENT.json and models.mock(("a",))("", "u", models.ANSWER) == "a"
    with pytest.raises(ValueError):
        models.backend("other")


def test_schema_and_role_files(spark, tmp_path):
    at = str(tmp_path / "schema")
    wanted = spark.createDataFrame([("b", "date", False), ("a", "string", True)], "name string, type string, multi boolean").withColumn("operators", schema.by_type(F.col("type"), schema.BY_TYPE))
    schema.write_schema(wanted, at)
    key = lambda df: sorted((r["name"], r["type"], r["multi"], tuple(r["operators"])) for r in df.collect())
    assert key(schema.read_schema(spark, at)) == key(wanted)
    assert schema.supports(wanted, "b", "between") and not schema.supports(wanted, "a", "<") and schema.field(wanted, "c").isEmpty()
    odd = tmp_path / "odd.json"
    odd.write_text('{"fields": [{"name": "x", "type": "colour"}, {"name": ""}, {"type": "date"}, {"name": "x", "type": "date"}, {"name": "y", "type": "number", "operators": ["="], "description": "d"}]}')
    assert key(schema.read_schema(spark, str(odd))) == [("x", "string", False, ("=", "contains")), ("y", "number", False, ("=",))]
    odd.write_text("no json")
    assert schema.read_schema(spark, str(odd)) is None and schema.read_schema(spark, str(tmp_path / "none")) is None
    given = tmp_path / "roles.json"
    given.write_text('{"roles": {"Notes": "semantic", "Due": "ignore"}}')
    assert roles.read_overrides(spark, str(given)) == {"Notes": "semantic", "Due": "ignore"}
    given.write_text('{"Notes": "semantic"}')
    assert roles.read_overrides(spark, str(given)) == {"Notes": "semantic"}
    given.write_text("{")
    assert roles.read_overrides(spark, str(given)) == {} == roles.read_overrides(spark, str(tmp_path / "none"))


def client():
    """A listing of three pages of results; the third cursor is blank."""
    def fetch(kind, source_id, cursor, size):
        if source_id == "broken":
            raise OSError("down")
        at = int(cursor or 0)
        parent = {"type": "page_id", "page_id": "p9"} if at else {"type": "workspace", "workspace": True}
        return {"results": [{"id": f"{source_id or kind}{at}", "title": [{"plain_text": f"T{at}"}] if at else [], "parent": parent}], "has_more": True, "next_cursor": str(at + 1) if at < 2 else ""}

    return fetch


def test_listing_source(spark):
    at = "tests.test_rules:client"
    rows = listing.listed(spark, at, "data_source").orderBy("pos").collect()
    assert [(r["id"], r["title"]) for r in rows] == [("data_source0", listing.UNTITLED), ("data_source1", "T1"), ("data_source2", "T2")]
    assert sorted(r["id"] for r in listing.listed(spark, at, "row", ["a", "broken", "b"]).collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert listing.listed(spark, None, "page").count() == 0
    alone = pages.standalone_pages(listing.listed(spark, at, "page")).orderBy("page_id").collect()
    assert [tuple(r) for r in alone] == [("page0", "workspace", None), ("page1", "page_id", "p9"), ("page2", "page_id", "p9")]
    found = pages.load_pages(spark.createDataFrame([("page1",), ("gone",)], "page_id string"), spark.createDataFrame([("page1", "x")], "page_id string, content string"))
    assert [r["content"] for r in found.collect()] == ["x"]
    assert listing.reachable(client()) and not listing.reachable(None) and not listing.reachable(lambda *a: 1 / 0)


def test_trees_of_any_depth_and_many_paths(spark):
    """Eight pages a level, all linked to all of the next: 8^8 paths, every page found once. Child pages are found, not entered."""
    links = [("0", f"0{s}") for s in range(8)] + [(f"{i}{s}", f"{i + 1}{t}") for i in range(7) for s in range(8) for t in range(8)] + [("70", "0")]
    got = pages.child_pages(spark.createDataFrame([("0", "s", "n")], "page_id string, source_id string, source_name string"), spark.createDataFrame(links, "parent_id string, child_id string")).collect()
    assert len(got) == 65 and max(r["depth"] for r in got) == 8
    rows = [("p", "a", None, 1, "paragraph"), ("p", "b", "a", 0, "child_page"), ("p", "c", "b", 0, "child_page"), ("p", "t", None, 0, "table"), ("p", "d", "t", 0, "child_page")]
    blocks = spark.createDataFrame(rows, "page_id string, block_id string, parent_id string, position int, type string")
    assert [r["child_id"] for r in pages.child_page_ids(blocks).orderBy("pos").collect()] == ["d", "b"]
    assert [r["block_id"] for r in pages.flatten_blocks(blocks).orderBy("pos").collect()] == ["t", "a", "b"]


def test_sync_job(spark, tmp_path):
    kind = "id string, title string, content string, last_edited_time string"
    docs = lambda *rows: spark.createDataFrame(rows, kind).withColumn("properties", corpus.properties(lang=corpus.string_value(F.lit("en"))))
    at = str(tmp_path / "store")
    first = sync.run(docs(("1", "t", "red cat", "a"), ("2", "t", "blue dog", "b")), at)
    assert (first["documents_new"], first["chunks_written"], first["columns_planned"]) == (2, 2, 3)
    again = sync.run(docs(("1", "t", "red fox", "z"), ("2", "t", "ignored", "b"), ("3", "t", "tree", "")), at)
    assert (again["documents_new"], again["documents_changed"], again["documents_skipped"]) == (1, 1, 1)
    points = {r["document_id"]: r for r in sync.stored_points(spark, f"{at}/points").collect()}
    assert {k: r["body"] for k, r in points.items()} == {"1": "red fox", "2": "blue dog", "3": "tree"} and all(len(r["embedding"]) == 64 for r in points.values())
    index = bm25.Index.load(spark, f"{at}/bm25")
    assert index.corpus.first()["n"] == 3 and index.term_stats.filter("term = 'cat'").isEmpty()
    assert schema.read_schema(spark, f"{at}/schema").count() == 1 and sync.exists(spark, f"{at}/points") and not sync.exists(spark, f"{at}/none")
    bad = spark.createDataFrame([("9_0", "9", "t", 0, None, "x", "x", "", None, [])], sync.KIND)
    with pytest.raises(Exception, match="empty embedding"):
        sync.write_documents(spark, f"{at}/points", bad, bad.select("document_id"))
    assert sync.main([str(tmp_path / "none"), at]) == 1


def test_written_tables_can_be_dropped(spark):
    from quarry import storage

    one = storage.written(spark.range(3), "some")
    files = one.inputFiles()
    assert one.count() == 3 and storage.drop_written(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(*files)


def test_sentences_split_at_any_white_space(spark):
    said = "One here.\u00a0Two there.\u2003Three at Bob. Four? (Five) end! no"
    got = spark.createDataFrame([(said,)], "t string").select(X.sentences(F.col("t")).alias("s")).first()["s"]
    assert got == ["One here.", "Two there.", "Three at Bob. Four?", "(Five) end! no"]


def test_stream_sync(spark, tmp_path):
    from quarry.streaming import sync_stream

    kind = "id string, title string, content string, last_edited_time string"
    src = tmp_path / "in"
    spark.createDataFrame([("1", "t", "old", "a"), ("2", "t", "same", "b")], kind).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = sync_stream.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        spark.createDataFrame([("1", "t", "new", "c"), ("2", "t", "ignored", "b"), ("3", "t", "more", "")], kind).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        got = {r["document_id"]: r["body"] for r in sync.stored_points(spark, str(tmp_path / "out" / "points")).collect()}
    finally:
        q.stop()
    assert got == {"1": "new", "2": "same", "3": "more"}


def test_shuffle_files_of_a_written_table_go_with_its_write(spark):
    """Without a collection of the driver's memory; the session keeps its own setting."""
    import os
    import time

    from quarry import storage

    def shuffled():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(storage.CLEANUP, None)
    df = spark.range(50_000).selectExpr("id % 1000 AS k", "id").repartition(6, "id").groupBy("k").sum("id")
    one = storage.written(df, "some")
    until = time.time() + 15
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(storage.CLEANUP, None) == setting
    assert sorted(one.collect()) == sorted(df.collect()) == sorted(df.collect())


def test_only_the_settled_table_stays(spark):
    from quarry import storage

    at = storage.shared_dir(spark)
    before = set(storage.names(spark, at))
    new = lambda: sorted(n.rsplit("-", 1)[0] for n in set(storage.names(spark, at)) - before)

    def make(fails=False):
        a = storage.written(spark.range(10), "a")
        b = storage.settled(lambda: storage.written(a.selectExpr("id * 2 AS id"), "deep").filter("id > 3"), "b")
        assert fails or new() == ["a", "b"]
        return a.join(b, "id") if not fails else a.selectExpr("raise_error('not this') AS id")

    one = storage.settled(make, "out")
    assert new() == ["out"] and sorted(r[0] for r in one.collect()) == [4, 6, 8]
    with pytest.raises(Exception, match="not this"):
        storage.settled(lambda: make(fails=True), "bad")
    held = storage.written(spark.range(2), "outside")
    assert held.count() == 2 and {"a", "b", "out", "outside"} <= set(new())
    storage.drop_written(spark)
    assert not {"a", "b", "out", "outside"} & set(new())


def test_merged_properties_of_odd_documents_equal_the_sql(spark, tmp_path):
    from quarry.plans import metadata

    texts, given = ("body", "", " \n", "\xa0", " ends ", None), ("en", "", " ", " de\n", None)
    rows = [(i * 3 + r, t, lang, source) for i, (t, lang, source) in enumerate((t, a, b) for t in texts for a in given for b in given) for r in range(3)]
    rows += [(-i, "below", "en", "s") for i in range(1, 4)] + [(None, "unnamed", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    same_as_sql(metadata.merge_semantic(spark, str(tmp_path)), metadata.ORACLES["merge_semantic"], str(tmp_path))


def test_merged_properties_leave_blanks_out(spark):
    said = F.expr("array(named_struct('label', 'A', 'text', ' a '), named_struct('label', 'B', 'text', ' '))")
    got = spark.createDataFrame([("body",), (" ",)], "c string").select(roles.merge_semantic(F.col("c"), said)).collect()
    assert [r[0] for r in got] == ["body\n\n## A\n\na", "## A\n\na"]


def test_every_passage_of_the_benchmark_is_reranked(spark):
    from quarry.plans import retrieval

    at = "/root/testdata/sf0.001"
    asked = {r["item_id"] for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id").collect()}
    assert {r["query_id"] for r in retrieval.rerank_topn(spark, at).collect()} == asked and len(asked) > 2
