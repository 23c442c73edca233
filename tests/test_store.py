"""Tables that are merged when they are read, index segments, and search over what was synchronised."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import bm25, context, sync
from quarry.operators.store import Table
from quarry.sources import corpus

KIND = "id string, title string, content string, last_edited_time string"


def rows_of(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), "document_id string, chunk_id string, v int", ("document_id", "chunk_id"), bloom=("document_id",), order=("document_id",))


def keyed(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_deleting_alone_empties_the_table(spark, table):
    fresh = spark.createDataFrame([("a", "a0", 1), ("a", "a1", 2)], table.columns)
    table.write(fresh)
    table.write(None, {"document_id": keyed(spark, "a")})
    assert rows_of(table) == [] and rows_of(table, 1) == [("a", "a0", 1), ("a", "a1", 2)]
    table.write(fresh.limit(1))
    assert rows_of(table) == [("a", "a0", 1)]
    assert table.compact(whole=True) == 2 and rows_of(table) == [("a", "a0", 1)]
    assert [s.kind for s in table.segments()] == ["rows"] and table.vacuum() == 3 and rows_of(table) == [("a", "a0", 1)]


def test_any_history_equals_a_dictionary(spark, table):
    """Random upserts and deletions by both keys, with compactions between, against a plain dictionary."""
    rng, plain = random.Random(5), {}
    for step in range(7):
        fresh = {f"c{rng.randrange(30)}": (f"d{rng.randrange(6)}", step) for _ in range(6)}
        docs = {f"d{rng.randrange(6)}" for _ in range(rng.randrange(3))}
        gone = {"chunk_id": keyed(spark, *fresh)} | ({"document_id": keyed(spark, *docs)} if docs else {})
        table.write(spark.createDataFrame([(d, c, v) for c, (d, v) in fresh.items()], table.columns), gone)
        plain = {c: (d, v) for c, (d, v) in plain.items() if d not in docs and c not in fresh} | fresh
        if step in (3, 5):
            assert table.compact(least=2, ratio=1.5) >= 2
        assert rows_of(table) == sorted((d, c, v) for c, (d, v) in plain.items())
    assert rows_of(table, 2) != rows_of(table)


def test_small_batches_write_little(spark, tmp_path):
    wide = Table(spark, str(tmp_path / "w"), "document_id string, text string", ("document_id",), order=("document_id",))
    docs = spark.range(20_000).select(F.col("id").cast("string").alias("document_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    wide.write(docs)
    whole = sum(s.size for s in wide.segments())
    ten = docs.filter("CAST(document_id AS INT) < 10")
    wide.write(ten, {"document_id": ten.select(F.col("document_id").alias("key"))})
    assert sum(s.size for s in wide.segments()) - whole < 0.01 * whole and wide.read().count() == 20_000
    assert wide.compact() == 0  # a large and a small segment are left alone
    assert wide.live_of(keyed(spark, "5", "none"), "document_id").count() == 1
    with pytest.raises(ValueError, match="no keys"):
        wide.write(None, {"text": keyed(spark, "x")})


def test_a_taken_version_is_refused(spark, table):
    from quarry import storage

    table.commit([])
    with pytest.raises(FileExistsError):
        storage.put_text(spark, f"{table.path}/manifest/{1:010d}.json", "[]")
    table.rollback(0)
    assert not table.exists() and table.segments() == [] and table.read().count() == 0


def as_sets(index):
    posts = {(r["chunk_id"], r["term"], r["tf"], r["dl"]) for r in index.postings.collect()}
    stats = {(r["term"], r["df"], round(r["idf"], 9)) for r in index.term_stats.collect()}
    bounds = {(r["term"], r["block"]): (r["n"], r["most"], r["least"]) for r in index.blocks.collect()}
    for r in index.postings.collect():
        _, most, least = bounds[r["term"], r["block"]]
        assert r["tf"] <= most and r["dl"] >= least
    return posts, stats, tuple(index.corpus.first()), {k: v[0] for k, v in bounds.items()}


def test_index_of_batches_equals_a_rebuild(spark, tmp_path):
    at, words = str(tmp_path / "i"), "red green blue black white".split()
    rng, plain, version = random.Random(3), {}, 0
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "chunk_id string, text string")
    for step in range(4):
        fresh = {f"c{rng.randrange(12)}": " ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(5)}
        gone = {c: t for c, t in plain.items() if c in fresh or rng.random() < 0.2}
        plain = {c: t for c, t in plain.items() if c not in gone} | fresh
        if step == 2:  # a job that died after the index took its batch
            bm25.update(spark, at, frame({"lost": "red red"}), frame({}), version)
        version = bm25.update(spark, at, frame(fresh), frame(gone), version)
        assert as_sets(bm25.Index.load(spark, at, version)) == as_sets(bm25.build(frame(plain)))
    assert bm25.compact(spark, at, least=2, ratio=100.0) >= 2
    assert as_sets(bm25.Index.load(spark, at)) == as_sets(bm25.build(frame(plain)))


def test_search_by_blocks_equals_all_scores(spark, tmp_path):
    """Random texts with rare and very frequent terms (whose weight can be negative), one to six terms a query; blocks are left out."""
    rng = random.Random(8)
    terms = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(40) for _ in range(40 - i)]
    texts = [(i, " ".join(rng.choices(terms, k=rng.choice([3, 12, 60, 300])))) for i in range(600)]
    index = bm25.build(spark.createDataFrame(texts, "chunk_id long, text string"))
    asked = spark.createDataFrame([(i, " ".join(rng.choices(terms, k=rng.randrange(1, 7)))) for i in range(40)] + [(99, "absent")], "query_id long, text string")
    by = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    for k in (1, 10):
        found, report = bm25.search(index, asked, k, first=4)
        assert by(found) == by(bm25.top_k(bm25.scores(index, asked), k))
        read = report.groupBy().sum("blocks", "blocks_read", "postings", "postings_read").first()
        assert read[1] < read[0] and read[3] < read[2]


def test_compaction_deals_rows_out_however_well_they_compress(spark, table, monkeypatch):
    from quarry.operators import store

    monkeypatch.setattr(store, "PART_ROWS", 100, raising=False)
    for a in (0, 500):
        table.write(spark.range(a, a + 500).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("document_id"), F.col("id").cast("string").alias("chunk_id"), F.lit(1).alias("v")))
    assert table.compact(least=2) == 2
    assert table.read().count() == 1000
    assert table.read().groupBy(F.spark_partition_id(), F.input_file_name()).count().agg(F.max("count")).first()[0] <= 250


def test_a_frequent_term_beside_a_rare_one_is_not_read_for_every_query(spark):
    """Titles as queries: each has a term of its own and one that all chunks have; equal scores are ordered by id."""
    index = bm25.build(spark.createDataFrame([(i, f"src own{i} " + "x " * (i % 7)) for i in range(400)], "chunk_id long, text string"))
    asked = spark.createDataFrame([(i, f"src own{i}") for i in range(0, 400, 20)], "query_id long, text string")
    found, report = bm25.search(index, asked, 3, first=4)
    by = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert by(found) == by(bm25.top_k(bm25.scores(index, asked), 3))
    assert all(r["postings"] == 401 and r["postings_read"] <= 20 for r in report.collect())


def test_a_frequent_term_is_not_read_beside_a_rare_one_of_a_long_text(spark):
    """The text that has a query's own term is so long that the term adds less than the one that all chunks have."""
    index = bm25.build(spark.createDataFrame([(i, f"src own{i} " + "x " * (3000 if i % 20 == 0 else i % 7)) for i in range(400)], "chunk_id long, text string"))
    asked = spark.createDataFrame([(i, f"src own{i}") for i in range(0, 400, 20)], "query_id long, text string")
    found, report = bm25.search(index, asked, 3, first=4)
    by = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert by(found) == by(bm25.top_k(bm25.scores(index, asked), 3))
    assert all(r["postings"] == 401 and r["postings_read"] <= 20 for r in report.collect())


def test_terms_are_counted_in_the_row_and_scored_at_their_chunk(spark):
    """Counting moves nothing; chunk_ids that repeat add up; few queries move postings by chunk, not by query and chunk."""
    rows = [(1, "b a B"), (2, ""), (3, None), (4, "a")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    plan = chunks.select(bm25._counted(F.sort_array(F.split("text", " "))))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {(r["chunk_id"], r["dl"], r["term"], r["tf"]) for r in bm25.term_counts(chunks).collect()}
    assert got == {(1, 3, "a", 1), (1, 3, "b", 2), (1, 3, None, 1), (2, 0, None, 1), (3, 0, None, 1), (4, 1, "a", 1), (4, 1, None, 1)}
    twice = bm25.term_counts(spark.createDataFrame([(1, "a b"), (1, "a a")], "chunk_id long, text string")).filter("term IS NOT NULL").collect()
    assert sorted((r["term"], r["tf"]) for r in twice) == [("a", 3), ("b", 1)]
    index = bm25.build(chunks)
    scored = bm25.scores(index, spark.createDataFrame([(7, "a b"), (8, "b")], "query_id long, text string"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(query_id") == 0 and plan.count("hashpartitioning(chunk_id") >= 1


def test_sync_then_filtered_search_then_citations(spark, tmp_path):
    """What was synchronised is searched with filters on stored properties, and cited; documents change, go and come."""
    at = str(tmp_path / "s")

    def docs(*rows):
        df = spark.createDataFrame(rows, KIND + ", lang string, note string")
        semantic = F.when(F.col("note") != "", F.array(F.struct(F.lit("Summary").alias("label"), F.col("note").alias("text")))).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
        return df.withColumn("properties", corpus.properties(lang=corpus.string_value(F.col("lang")))).withColumn("semantic", semantic).drop("lang", "note")

    sync.run(docs(("a", "Alpha", "the red fox jumps", "1", "en", ""), ("b", "Beta", "the red hen sleeps", "1", "de", "about poultry farms"), ("c", "Gamma", "blue whales", "1", "en", "")), at)
    ask = lambda text, mode="hybrid": sync.open_engine(spark, at, Settings(mode=mode)).ask(spark.createDataFrame([(1, text)], "query_id long, text string"))
    found = ask("red lang: de").orderBy("fused_rank").collect()
    assert [r["document_id"] for r in found] == ["b"] and found[0]["properties"]["lang"]["text"] == "de"
    assert "## Summary\n\nabout poultry farms" in found[0]["content"]
    assert [r["document_id"] for r in ask("poultry", "bm25").collect()] == ["b"]
    assert {r["document_id"] for r in ask("lang: en").collect()} == {"a", "c"}
    sync.run(docs(("b", "Beta", "a green hen", "2", "en", ""), ("d", "Delta", "red herring", "2", "de", "")), at)
    assert ask("poultry", "bm25").count() == 0
    assert [r["document_id"] for r in ask("red lang: de").collect()] == ["d"]
    sync.apply(spark, at, sync.stored_points(spark, f"{at}/points").limit(0), spark.createDataFrame([("d",)], "document_id string"))
    assert ask("red lang: de").count() == 0 and ask("herring", "bm25").count() == 0
    assert sync.compact(spark, at, whole=True)["points"] >= 2
    again = ask("red fox").orderBy("fused_rank").collect()
    assert again[0]["document_id"] == "a"
    seen = context.build_context(ask("red fox").withColumnRenamed("fused_rank", "rank"))
    answers = spark.createDataFrame([(1, "Foxes jump [1], and [9] says nothing.")], "query_id long, answer string")
    assert [r["chunk_id"] for r in context.citations(answers, seen).collect()] == ["a_0"]


def test_schema_of_batches_equals_a_full_scan(spark, tmp_path):
    """Ten batches that add, replace and delete documents whose properties change their kinds."""
    from quarry.operators import schema

    at, rng = str(tmp_path / "s"), random.Random(11)
    for step in range(5):
        rows = [(f"d{rng.randrange(5)}", step, rng.randrange(4)) for _ in range(3)]
        df = spark.createDataFrame([r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}], "id string, step int, k int")
        value = F.when(F.col("k") == 0, corpus.string_value(F.lit("2024-01-01"))).when(F.col("k") == 1, corpus.string_value(F.lit("x y"))).when(F.col("k") == 2, corpus.whole_value(F.col("step"))).otherwise(corpus.list_value(F.array(F.lit("p"))))
        df = df.select("id", F.lit("t").alias("title"), F.lit("some text").alias("content"), F.col("step").cast("string").alias("last_edited_time"), corpus.properties(a=value, b=corpus.flag_value(F.when(F.col("k") < 2, True))).alias("properties"))
        said = sync.run(df, at)
        assert "schema_error" not in said
        points = sync.stored_points(spark, f"{at}/points")
        full = schema.infer_schema(points)
        assert sorted(map(tuple, sync.stored_schema(spark, at).collect())) == sorted(map(tuple, full.collect()))
        assert {c for c in points.columns if "__" in c} >= {"a__norm"} if step else True
    table = sync.points_table(spark, f"{at}/points")
    assert sync.provide(spark, f"{at}/points", table.note()["columns"]) == 0
