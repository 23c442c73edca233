"""Block trees read from a source, a level a round: each parent's listing is a chain of cursors that one task follows, the
parents of a level are spread over the tasks, and what a round found is written before the next one starts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.listing import pages_of
from quarry.storage import written

#: Blocks whose children belong to another page.
CLOSED = ("child_page", "child_database")
KIND = "above string, block_id string, position int, type string, has_children boolean, json string"


def _children(client: str):  # noqa: ANN202
    """The children of each block in a task, by a client made once (`module:factory`, which returns a Fetch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, factory = client.split(":")
        fetch = getattr(import_module(module), factory)()
        for batch in batches:
            for above in batch.column(0).to_pylist():
                found = [(i, b) for i, b in enumerate(pages_of(fetch, "block", above)) if isinstance(b.get("id"), str)]
                yield pa.RecordBatch.from_pydict({
                    "above": pa.array([above] * len(found), pa.string()), "block_id": pa.array([b["id"] for _, b in found], pa.string()), "position": pa.array([i for i, _ in found], pa.int32()),
                    "type": pa.array([str(b.get("type") or "") for _, b in found], pa.string()), "has_children": pa.array([bool(b.get("has_children")) for _, b in found]),
                    "json": pa.array([json.dumps(b) for _, b in found], pa.string()),
                })

    return run


def read_blocks(pages: DataFrame, client: str, tasks: int = 64, most_levels: int | None = None) -> DataFrame:
    """page_id, block_id, parent_id (null at the top), position, type, json of all blocks of the pages (page_id), as
    pages.flatten_blocks takes them. Every block's children are listed once in a run, however often it is met: a level
    leaves out what earlier levels have listed, and a block that two pages show is listed for both at once. Child pages
    are not entered. A listing that fails is empty, as is that of a page without blocks; repeated and null pages are
    listed once or not at all. Blocks without an id are left out. tasks: how many listings run at a time, at most."""
    level = pages.filter("page_id IS NOT NULL").select("page_id").distinct().select("page_id", F.col("page_id").alias("block_id"), F.lit(None).cast("string").alias("parent_id"))
    found, listed, known, n = None, None, None, 0
    while most_levels is None or n < most_levels:
        level = written(level, "frontier")
        if level.isEmpty():
            break
        parents = level.select(F.col("block_id").alias("above")).distinct()
        fresh = parents if listed is None else written(parents.join(listed, "above", "left_anti"), "parents")
        got = written(fresh.repartition(tasks, "above").mapInArrow(_children(client), KIND), "listed")
        children = got if known is None else known.unionByName(got)
        # A block met again (by another page, or on a cycle) takes the children that are known, unless its page has them.
        below = level.withColumnRenamed("block_id", "above").join(children, "above").select("page_id", "block_id", F.when(F.col("above") != F.col("page_id"), F.col("above")).alias("parent_id"), "position", "type", "has_children", "json")
        if found is not None:
            below = below.join(found.select("page_id", "block_id"), ["page_id", "block_id"], "left_anti")
        below = written(below.dropDuplicates(["page_id", "block_id"]), "blocks")
        found = below if found is None else found.unionByName(below)
        listed = parents if listed is None else listed.unionByName(fresh)
        known = children
        level = below.filter(F.col("has_children") & ~F.col("type").isin(*CLOSED) & (F.col("block_id") != F.col("page_id"))).select("page_id", "block_id", "parent_id")
        n += 1
    if found is None:
        return pages.sparkSession.createDataFrame([], "page_id string, block_id string, parent_id string, position int, type string, json string")
    return found.drop("has_children")
