"""The evaluations as programs: dense retrieval alone, four pipelines side by side, rule against model intents, and answers.
Each takes an engine's parts and a table of cases (case_id, query, category, expected) and returns tables and a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import context, evaluation, filter_rows, models
from quarry.operators.engine import Engine
from quarry.storage import written


def timed(engine: Engine, mode: str, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ranked (mode, case_id, rank, chunk_id, document_id) of a run, written, and its timings (mode, stage, ms). The pipeline
    runs once: each stage reads what the one before wrote, so the stages add up to the total. ms is a batch's time by its
    queries."""
    spark, took, n = cases.sparkSession, [], max(1, cases.count())

    def stage(name: str, run: Callable):  # noqa: ANN202
        """What run gives, planned and done within the stage's time."""
        began = time.perf_counter()
        out = run()
        out = written(out, f"timed-{name}") if isinstance(out, DataFrame) else out
        took.append((mode, name, 1000 * (time.perf_counter() - began) / n))
        return out

    began = time.perf_counter()
    requests = stage("analysis", lambda: engine.analyzer(cases.select(F.col("case_id").alias("query_id"), F.col("query").alias("text"))))
    sets, asked = stage("filters", lambda: filter_rows.filter_sets(requests))
    alone = {name: replace(engine, settings=replace(engine.settings, mode=name)) for name in ("vector", "bm25") if engine.settings.mode in (name, "hybrid")}
    lists = {name: stage(name, lambda: one.lists(asked, sets)[name]) for name, one in alone.items()}  # noqa: B023
    found = stage("fusion", lambda: engine.fused(lists))
    found = stage("rerank" if engine.settings.rerank else "sources", lambda: engine.ranked(found, asked).select("query_id", "fused_rank", "chunk_id", "document_id"))
    took.append((mode, "total", 1000 * (time.perf_counter() - began) / n))
    ranked = found.select(F.lit(mode).alias("mode"), F.col("query_id").alias("case_id"), F.col("fused_rank").alias("rank"), "chunk_id", "document_id")
    return ranked, spark.createDataFrame(took, "mode string, stage string, ms double")


def compare(engines: dict[str, Engine], cases: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """judged cases, timings and a text report of several engines on the same cases."""
    runs = [timed(engine, mode, cases) for mode, engine in engines.items()]
    ranked, timings = runs[0]
    for r, t in runs[1:]:
        ranked, timings = ranked.unionByName(r), timings.unionByName(t)
    judged = written(evaluation.per_case(cases.select("case_id", "category", "expected"), ranked, list(engines)), "judged")
    said = [evaluation.report(cases, judged), evaluation.performance_table(judged, timings), evaluation.latency_table(timings), evaluation.table_text(evaluation.by_category(judged).orderBy("mode", "category"))]
    return judged, timings, "\n\n".join(said)


def vector_evaluation(engine: Engine, cases: DataFrame, depth: int = 10):
    return compare({"vector": replace(engine, settings=replace(engine.settings, mode="vector", rerank=False, sources=depth))}, cases)


def pipeline_comparison(engine: Engine, cases: DataFrame, depth: int = 25):
    """Vector, BM25, hybrid, and hybrid with reranking."""
    of = lambda mode, rerank=False: replace(engine, settings=replace(engine.settings, mode=mode, rerank=rerank, sources=depth, pool=depth, top_n=depth))
    return compare({"vector": of("vector"), "bm25": of("bm25"), "hybrid": of("hybrid"), "hybrid_reranked": of("hybrid", True)}, cases)


def intent_comparison(ruled: Engine, modelled: Engine, cases: DataFrame, depth: int = 10):
    """The same retrieval with rule requests and with rule and model requests, and how the metrics moved."""
    of = lambda e: replace(e, settings=replace(e.settings, sources=depth))
    judged, timings, said = compare({"rules": of(ruled), "rules_and_model": of(modelled)}, cases)
    moved = evaluation.deltas(evaluation.metrics(judged, "mode"), "rules")
    return judged, timings, said + "\n\n" + evaluation.table_text(moved.orderBy("mode"))


def answers(engine: Engine, queries: DataFrame, generate: models.Generate | None = None, how: models.Generation = models.ANSWER) -> tuple[DataFrame, DataFrame]:
    """query_id, text, answer, generation_ms, citations of queries (query_id, text), and their contexts. A blank query is
    refused. Only the model's time is measured."""
    found = engine.ask(queries).withColumn("rank", F.col("fused_rank"))
    sources = written(context.build_context(found, engine.settings.token_budget), "context")
    said = models.answer(context.prompts(queries, sources), generate or models.mock(), how)
    said = written(said.withColumn("answer", F.trim("answer")), "answers")
    cited = context.citations(said, sources).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "reference_id", "chunk_id"))).alias("citations"))
    return queries.select("query_id", "text").join(said, "query_id").join(cited, "query_id", "left"), sources


def generation_evaluation(engine: Engine, queries: DataFrame, generate: models.Generate | None = None) -> tuple[DataFrame, str]:
    """answers() and their markdown report."""
    said, sources = answers(engine, queries, generate)
    return said, evaluation.generation_report(said, sources)
