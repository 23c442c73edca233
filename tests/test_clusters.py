"""Search by clusters and bounds finds what a search over all vectors finds."""

from __future__ import annotations

import numpy as np
import pytest

from quarry.operators import clusters, vectors

KIND = "chunk_id string, embedding array<double>"


def grouped(n: int, seed: int = 3) -> list[tuple[str, list[float] | None]]:
    """Vectors around ten directions, some without a direction, equal ones and a null."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(10, 16))
    rows = [(f"v{i}", (middle[i % 10] + 0.15 * rng.normal(size=16)).tolist()) for i in range(n)]
    return rows + [("zero1", [0.0] * 16), ("zero2", [0.0] * 16), ("twin", rows[0][1]), ("none", None)]


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_pruned_search_is_exact(spark, k):
    table = spark.createDataFrame(grouped(2000), KIND).repartition(5)
    given = grouped(2000)
    asked = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(given[:40] + given[2000:2001])] + [("far", (-np.array(given[0][1])).tolist())], "query_id string, embedding array<double>")
    index = clusters.build(table, clusters=24, sample=500)
    assert int(index.n.sum()) == 2003
    found, work = clusters.search(index, asked, k, most_bytes=2000)
    assert rows_of(found) == rows_of(vectors.search(table, asked, k))
    assert work.read == work.pairs if k == 5000 else work.read < 0.5 * work.pairs and work.compared < 0.5 * 42 * 2003


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], KIND), spark.createDataFrame([("a", [1.0, 0.0])], KIND)
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<double>")
    assert clusters.search(clusters.build(none), asked, 3)[0].isEmpty()
    assert clusters.search(clusters.build(one), asked.limit(0), 3)[0].isEmpty()
    assert rows_of(clusters.search(clusters.build(one), asked, 3)[0]) == [("q", 1, "a", 0.707107)]
