"""Search as one pipeline over a table of requests: an analyzer turns queries into semantic text and filters, strategies
rank, fusion and reranking follow. Each request has its own filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import Settings
from quarry.operators import bm25, filter_rows, fusion, models, vectors
from quarry.operators.requests import DEFAULT_FIELDS, Field, parse_queries
from quarry.storage import written

Analyzer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Engine:
    """chunks: chunk_id, content, properties and others; embeddings: chunk_id, embedding; index: a BM25 index (or a
    callable that loads one when it is first needed); analyzer: from query_id, text to query_id, semantic_query, filters;
    encode: texts to vectors, for requests without given ones."""

    chunks: DataFrame
    settings: Settings = Settings()
    embeddings: DataFrame | None = None
    index: bm25.Index | Callable[[], bm25.Index] | None = None
    analyzer: Analyzer = parse_queries
    encode: models.Encoder = models.hashed_tokens

    def ask(self, queries: DataFrame, query_vectors: DataFrame | None = None, score: Column | None = None) -> DataFrame:
        """search() of what the analyzer makes of query_id and text."""
        return self.search(self.analyzer(queries), query_vectors, score)

    def search(self, requests: DataFrame, query_vectors: DataFrame | None = None, score: Column | None = None) -> DataFrame:
        """query_id, fused_rank, chunk_id, score and the chunk, at most settings.sources a request. requests: query_id,
        semantic_query and, if any has some, filters (array<struct<field, operator, value or values>>). query_vectors:
        query_id and embedding. A request without semantic text ranks by its filters alone (by chunk_id, score 0).
        score replaces the fused order where reranking is on."""
        sets, asked = filter_rows.filter_sets(requests)
        return self.ranked(self.fused(self.lists(asked, sets, query_vectors)), asked, score)

    def lists(self, asked: DataFrame, sets: DataFrame | None, query_vectors: DataFrame | None = None) -> dict[str, DataFrame]:
        """What each strategy of the mode finds (query_id, chunk_id, score, rank), for requests with the filter_set that they
        ask for (filter_rows.filter_sets)."""
        depth, lists = self.settings.depth, {}
        if self.settings.mode in ("vector", "hybrid"):
            if self.embeddings is None:
                raise ValueError("vector search needs embeddings")
            lists["vector"] = self._dense(asked, sets, query_vectors, depth)
        if self.settings.mode in ("bm25", "hybrid"):
            if self.index is None:
                raise ValueError("lexical search needs an index")
            index = self.index() if callable(self.index) else self.index
            lists["bm25"] = bm25.top_k(self._passing(bm25.scores(index, asked, "semantic_query"), asked, sets), depth)
        return lists

    def fused(self, lists: dict[str, DataFrame]) -> DataFrame:
        """query_id, fused_rank, chunk_id, score."""
        whole = None
        for i, one in enumerate(lists.values()):
            part = one.select("query_id", F.lit(i).alias("strategy"), "rank", "chunk_id", "score")
            whole = part if whole is None else whole.unionByName(part)
        return fusion.reciprocal_rank(whole, self.settings.rrf_k) if len(lists) > 1 else fusion.concatenated(whole).drop("strategy", "rank")

    def ranked(self, fused: DataFrame, asked: DataFrame, score: Column | None = None) -> DataFrame:
        """The fused rows with their chunks, reranked if that is on, at most settings.sources a request."""
        out = fusion.beside(fused, self.chunks)
        if self.settings.rerank:
            placed = out.withColumn("rank", F.col("fused_rank")).join(asked.select("query_id", F.col("semantic_query").alias("question")), "query_id")
            scored = score if score is not None else fusion.overlap_score(F.col("question"), F.col("content"))
            out = fusion.rerank(placed, scored, self.settings.pool, self.settings.top_n).drop("rank", "fused_rank", "question").withColumnRenamed("new_rank", "fused_rank")
        return out.filter(F.col("fused_rank") <= self.settings.sources)

    def _dense(self, asked: DataFrame, sets: DataFrame | None, query_vectors: DataFrame | None, depth: int) -> DataFrame:
        blank = F.trim(F.coalesce("semantic_query", F.lit(""))) == ""
        spoken = asked.filter(~blank)
        if query_vectors is None:
            texts = spoken.select(F.col("query_id").alias("chunk_id"), F.col("semantic_query").alias("text"))
            query_vectors = models.embed(texts, self.encode).withColumnRenamed("chunk_id", "query_id")
        wanted = query_vectors.select("query_id", "embedding").join(spoken.select("query_id", "filter_set"), "query_id")
        rows, first = self.embeddings.select("chunk_id", "embedding"), self.chunks.select("chunk_id").orderBy("chunk_id").limit(depth).withColumn("filter_set", F.lit(-1).cast("long"))
        if sets is not None:
            passed = written(filter_rows.passing(self.chunks, sets, "index"), "passed")
            of_chunk = self.chunks.select("chunk_id").join(passed.groupBy("chunk_id").agg(F.collect_list("filter_set").alias("passed")), "chunk_id", "left")
            rows = rows.join(of_chunk, "chunk_id")
            first = first.unionByName(passed)
        found = vectors.search(rows, wanted, depth)
        by_filters = first.withColumn("rank", F.row_number().over(W.partitionBy("filter_set").orderBy("chunk_id"))).filter(F.col("rank") <= depth)
        alone = asked.filter(blank).select("query_id", "filter_set").join(by_filters, "filter_set")
        return found.unionByName(alone.select("query_id", "chunk_id", F.lit(0.0).alias("score"), "rank"))

    def _passing(self, found: DataFrame, asked: DataFrame, sets: DataFrame | None) -> DataFrame:
        """The rows whose chunk passes the filters of their request."""
        if sets is None:
            return found
        passed = filter_rows.passing(self.chunks, sets, "memory").withColumn("_passed", F.lit(True))
        both = found.join(asked.select("query_id", "filter_set"), "query_id").join(passed, ["chunk_id", "filter_set"], "left")
        return both.filter((F.col("filter_set") < 0) | F.col("_passed")).select(*found.columns)


def build_engine(chunks: DataFrame, settings: Settings, embeddings: DataFrame | None = None, index=None, fields: DataFrame | None = None, schema: DataFrame | None = None, intent: Callable[[DataFrame], DataFrame] | None = None, today: str | None = None) -> Engine:  # noqa: ANN001
    """The engine that the settings ask for. fields: names of indexed properties (name, multi), from which the field syntax
    is learned (the defaults if there are none). intent: from query_id, text to query_id, answer of a model; it is asked
    only if settings.intent is on and there is a schema."""
    from quarry.operators.requests import analyze

    known = DEFAULT_FIELDS if fields is None else registry_fields(fields) or DEFAULT_FIELDS
    analyzer: Analyzer = lambda queries: parse_queries(queries, known)
    if settings.intent and schema is not None and intent is not None and not schema.isEmpty():
        analyzer = lambda queries: analyze(queries, intent(queries), known, schema, today or settings.today())
    return Engine(chunks, settings, embeddings, index, analyzer)


def registry_fields(fields: DataFrame) -> tuple[Field, ...]:
    """Fields of the syntax from indexed names: one row a property name, so a small table."""
    from quarry.operators.schema import registry

    rows = registry(fields).groupBy("canonical").agg(F.sort_array(F.collect_set("surface")).alias("surfaces"), F.max("kind").alias("kind"), F.max("multi").alias("multi")).orderBy("canonical").collect()
    return tuple(Field(r["canonical"], tuple(r["surfaces"]), "date" if r["kind"] == "date" else "text", r["multi"]) for r in rows)
