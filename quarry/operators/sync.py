"""Incremental maintenance of the stored points: what changed, what goes, what comes. Points are a table that is merged when
it is read (quarry.operators.store), and the lexical index follows by the same batches, so a synchronisation reads and writes
what changed and not what is stored."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import bm25, columns, models, roles, schema
from quarry.operators.chunking import chunk_documents
from quarry.operators.engine import Engine
from quarry.operators.store import Table
from quarry.sources.corpus import VALUE
from quarry.storage import written

REQUIRED = ("chunk_id", "document_id", "document_title", "content")


def checked_points(points: DataFrame) -> DataFrame:
    """The points; a row without a required value stops the scan."""
    missing = [c for c in REQUIRED if c not in points.columns]
    if missing:
        raise ValueError(f"points lack {missing}")
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in REQUIRED))
    return points.withColumn("chunk_id", F.when(whole, F.col("chunk_id")).otherwise(F.raise_error(F.lit("a stored point lacks a required value"))))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New points and those stored points that they do not replace."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def delete_documents(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def plan(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """document_id, action: new, unchanged (equal edit times that are not empty) or changed. Documents that are no longer
    there stay stored."""
    before = stored.select("document_id", F.col("last_edited_time").alias("before")).groupBy("document_id").agg(F.min("before").alias("before")).withColumn("there", F.lit(True))
    same = (F.col("before") == F.col("last_edited_time")) & (F.col("before") != "")
    action = F.when(F.col("there").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return documents.select("document_id", "last_edited_time").join(before, "document_id", "left").select("document_id", action.alias("action"))


def counters(planned: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    return planned.agg(F.count("*").alias("documents_seen"), n("new").alias("documents_new"), n("changed").alias("documents_changed"), n("unchanged").alias("documents_skipped"))


KIND = (
    "chunk_id string, document_id string, document_title string, chunk_index int, section_title string, content string, body string, last_edited_time string, "
    f"properties map<string, {VALUE}>, embedding array<float>"
)


def points_table(spark: SparkSession, path: str, provided: list[str] | None = None) -> Table:
    """The table of points; provided: its typed columns, by default those that its last version has."""
    table = lambda more: Table(spark, path, KIND + columns.ddl(more), ("document_id", "chunk_id"), bloom=("document_id", "chunk_id"), order=("document_id", "chunk_index"))
    return table(table([]).note().get("columns", []) if provided is None else provided)


def counts_table(spark: SparkSession, path: str) -> Table:
    """How many values of each kind a property has, as signed counts of the batches."""
    return Table(spark, path, "name string, list long, plain long, dated long, flag long, number long", ())


def stored_schema(spark: SparkSession, path: str) -> DataFrame:
    """The schema of what is stored under path, from the batches' counts."""
    version = points_table(spark, f"{path}/points").note().get("counts")
    return schema.of_seen(schema.merged(counts_table(spark, f"{path}/counts").read(version)))


def provide(spark: SparkSession, path: str, wanted: list[str]) -> int:
    """Adds typed columns to the table of points under path; returns how many are new. The table is written again only if it
    has rows and some are new."""
    table = points_table(spark, path)
    have = table.note().get("columns", [])
    new = sorted(set(wanted) - set(have))
    if new:
        wide = points_table(spark, path, sorted([*have, *new]))
        if any(s.kind == "rows" for s in table.segments()):
            wide.replace(columns.shred(table.read(), new).select(*(c for c in wide._scan([]).columns if c != "_number")))
        wide.commit(wide.segments(), table.note() | {"columns": sorted([*have, *new])})
    return len(new)


def ensure_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored points; an empty table is made where there is none."""
    table = points_table(spark, path)
    if not table.exists():
        table.commit([])
    return table.read()


def stored_points(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no points under {path}")
    return points_table(spark, path).read()


def exists(spark: SparkSession, path: str) -> bool:
    return points_table(spark, path).exists()


def write_documents(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame, note: dict | None = None) -> int:
    """Puts points in and takes those of the given documents (document_id) out, and those whose chunk_id comes again;
    returns how many came in. What is stored is neither read nor written. An empty embedding is refused."""
    missing = F.coalesce(F.size("embedding") == 0, F.lit(False))
    fresh = fresh.withColumn("chunk_id", F.when(missing, F.raise_error(F.lit("a point has an empty embedding"))).otherwise(F.col("chunk_id")))
    if "properties" not in fresh.columns:
        fresh = fresh.withColumn("properties", F.lit(None).cast(f"map<string, {VALUE}>"))
    table = points_table(spark, path)
    fresh = columns.shred(fresh, table.note().get("columns", []))
    again = fresh.join(gone.select("document_id").distinct(), "document_id", "left_anti").select(F.col("chunk_id").alias("key"))
    made = table.write(fresh, {"document_id": gone.select(F.col("document_id").alias("key")), "chunk_id": again}, note=table.note() | (note or {}))
    return made.rows if made else 0


def indexed_text(points: DataFrame) -> DataFrame:
    """chunk_id and the text that the lexical index reads."""
    return points.select("chunk_id", F.concat_ws("\n", "document_title", "content").alias("text"))


def points_of(documents: DataFrame, encode: Callable | None = None) -> DataFrame:
    """Chunks with embeddings of documents (id, title, content, last_edited_time; properties and semantic, texts with labels
    that become sections of the content, where they are there)."""
    given = documents.columns
    content = roles.merge_semantic(F.coalesce("content", F.lit("")), F.col("semantic")) if "semantic" in given else F.col("content")
    properties = F.col("properties") if "properties" in given else F.lit(None)
    chunks = chunk_documents(documents.select("id", "title", content.alias("content"), "last_edited_time", properties.cast(f"map<string, {VALUE}>").alias("properties")))
    vectors = models.embed(chunks.select("chunk_id", F.col("content").alias("text")), encode or models.hashed_tokens)
    return chunks.join(vectors, "chunk_id")


def run(documents: DataFrame, path: str, encode: Callable | None = None) -> dict:
    """One synchronisation of documents (as points_of() takes them) with what is stored under path: plan, chunk, embed, then
    the lexical index, the counts behind the schema and the points (with typed columns for all properties seen) take the
    batch. The points' version names the versions of index and counts that belong to it, so a job that dies between the two is as if it had not run. The schema
    never fails a run. Returns counters; a corpus without any text cannot be indexed and raises."""
    spark, began, said = documents.sparkSession, time.time(), {}
    stored = ensure_table(spark, f"{path}/points")
    known = stored.select("document_id", "last_edited_time").distinct()
    planned = written(plan(documents.select(F.col("id").alias("document_id"), "last_edited_time"), known), "plan")
    todo = planned.filter("action <> 'unchanged'").select("document_id")
    fresh = documents.join(todo.withColumnRenamed("document_id", "id"), "id", "left_semi")
    points = written(points_of(fresh, encode), "points")
    said["chunks_written"] = apply(spark, path, points, todo)
    if not sum(s.rows for s in points_table(spark, f"{path}/points").segments() if s.kind == "rows"):
        raise ValueError("nothing to index")
    said |= counters(planned).first().asDict()
    try:
        found = stored_schema(spark, path)
        schema.write_schema(found, f"{path}/schema")
        said["columns_planned"] = schema.index_plan(found, spark.createDataFrame([], "key string")).count()
        said["columns_built"] = len(points_table(spark, f"{path}/points").note().get("columns", []))
    except Exception as e:  # noqa: BLE001  a schema is a help, not a condition
        said["schema_error"] = str(e)[:200]
    said["seconds"] = round(time.time() - began, 1)
    return said


def apply(spark: SparkSession, path: str, points: DataFrame, gone: DataFrame) -> int:
    """Puts points into the table and the lexical index under path and takes the documents of gone (document_id) out of
    both."""
    table = points_table(spark, f"{path}/points")
    ensure_table(spark, f"{path}/points")
    if points.isEmpty() and gone.isEmpty():
        return 0
    dead = written(table.live_of(gone.select(F.col("document_id").alias("key")), "document_id").select("chunk_id", "document_title", "content", "properties"), "dead")
    version = bm25.update(spark, f"{path}/bm25", indexed_text(points), indexed_text(dead), table.note().get("index", 0))
    counts = counts_table(spark, f"{path}/counts")
    counts.rollback(table.note().get("counts", 0))
    less = schema.seen(dead)
    counts.write(schema.seen(points).unionByName(less.select("name", *((-F.col(c)).alias(c) for c in less.columns[1:]))))
    provide(spark, f"{path}/points", columns.wanted(schema.merged(counts.read())))
    return write_documents(spark, f"{path}/points", points, gone, {"index": version, "counts": max(counts.versions())})


def compact(spark: SparkSession, path: str, **how) -> dict:  # noqa: ANN003
    """Merges small segments of the points and of the index (Table.compact); returns how many of each."""
    table = points_table(spark, f"{path}/points")
    merged = {"points": table.compact(**how), "index": bm25.compact(spark, f"{path}/bm25", **how)}
    if merged["index"]:
        table.commit(table.segments(), table.note() | {"index": max(bm25._tables(spark, f"{path}/bm25")[0].versions())})
    return merged


def open_engine(spark: SparkSession, path: str, settings: Settings = Settings(), encode: Callable | None = None) -> Engine:
    """Search over what was synchronised: points, their vectors, the index of the same version, and the field syntax of the
    stored schema."""
    from quarry.operators.engine import build_engine

    table = points_table(spark, f"{path}/points")
    chunks = table.read().withColumnRenamed("document_title", "title")
    version = table.note()["index"]
    known = schema.read_schema(spark, f"{path}/schema")
    engine = build_engine(chunks.drop("embedding"), settings, chunks.select("chunk_id", "embedding"), lambda: bm25.Index.load(spark, f"{path}/bm25", version), None if known is None else known.select("name", "multi"))
    return engine if encode is None else Engine(engine.chunks, settings, engine.embeddings, engine.index, engine.analyzer, encode)


def main(args: list[str] | None = None) -> int:
    """Synchronises a Parquet table of documents: python -m quarry.operators.sync DOCUMENTS PATH. Exit 0, 1 after a
    failure, 130 after an interrupt."""
    documents, path = sys.argv[1:] if args is None else args
    try:
        spark = SparkSession.builder.appName("sync").getOrCreate()
        print(run(spark.read.parquet(documents), path))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  reported by the exit code
        print(f"sync failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
