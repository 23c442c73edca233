"""SimHash near-dedup. A text's fingerprint holds, bit by bit, what over half of its shingle hashes say; fingerprints that
differ in few bits are linked, and the components of links are groups of near duplicates.

Search is by BK-trees, whose children are keyed by their Hamming distance to the parent; a query follows only the edges
within the radius of its own distance. Trees are shards: with radius r the 64 bits are cut into r + 1 blocks, of which
linked fingerprints share one, so each block deals the distinct fingerprints to shards by its bits. A shard holds the
fingerprints that agree there and is searched by its own members, so no tree is sent to other shards or grows with the
corpus. A shard past `most` members is dealt again on blocks of the other bits, which is exact for the same reason. A
shard yields a spanning forest of its links, not all pairs.

Only distinct fingerprints are searched; copies meet in one aggregation and carry their least doc_id.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other; a text
of fewer words than a shingle is one shingle; very long texts are hashed in parts and counted whole; rows with a null doc_id get no component id of their own but the least
doc_id of their group (null if it has none); repeated rows each keep a row; an empty table gives no rows; other columns
are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions, small_batches, written
from quarry.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HASHES = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    found = text.translate(LOWER).split()  # of bytes: splits on ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - width + 1)
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(found)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        hashes = np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins[a : a + HASHES], stops[a : a + HASHES], strict=True)), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "print"])

    return run


class BKTree:
    """Nodes hold a fingerprint and their children by distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indexes of the nodes at most radius away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            edges = self.children[at]
            if len(edges) > 2 * radius + 1:
                todo.extend(edges[e] for e in range(d - radius, d + radius + 1) if e in edges)
            else:
                todo.extend(to for e, to in edges.items() if d - radius <= e <= d + radius)


def blocks(bits: list[int], n: int) -> list[int]:
    """The bits cut into n masks of nearly equal size."""
    size, more = divmod(len(bits), n)
    masks, at = [], 0
    for i in range(n):
        end = at + size + (i < more)
        masks.append(sum(1 << b for b in bits[at:end]))
        at = end
    return masks


def forest(values: list[int], radius: int, most: int, free: int = (1 << 64) - 1) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct values; free: the bits in which they may differ."""
    bits = [b for b in range(64) if free >> b & 1]
    if len(values) > most and len(bits) > radius + 1:
        for mask in blocks(bits, radius + 1):  # linked values share at least one block of the free bits
            shards: dict[int, list[int]] = {}
            for v in values:
                shards.setdefault(v & mask, []).append(v)
            for shard in shards.values():
                if len(shard) > 1:
                    yield from forest(shard, radius, most, free & ~mask)
        return
    tree, parent = BKTree(), {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        for at in tree.within(v, radius):
            a, b = root(v), root(tree.values[at])
            if a != b:
                parent[a] = b
                yield v, tree.values[at]
        tree.add(v)


def _search(radius: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(shard: list[int]) -> None:
            for a, b in forest(shard, radius, most):
                out.append((a, b))

        shard: list[int] = []
        last, out = None, []
        for batch in batches:
            keys = zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True)
            for key, value in zip(keys, batch.column("print").to_numpy().view(np.uint64).tolist(), strict=True):
                if key != last:
                    if len(shard) > 1:
                        linked(shard)
                    shard, last = [], key
                shard.append(value)
            if out:
                yield _links(out)
                out = []
        if len(shard) > 1:
            linked(shard)
        if out:
            yield _links(out)

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, radius: int, most: int = 2000) -> DataFrame:
    """Links a - b of a column `print` of distinct fingerprints that connect all those at most radius bits apart."""
    masks = [signed(m) for m in blocks(list(range(64)), radius + 1)]
    deals = F.array(*(F.struct(F.lit(i).alias("block"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))
    dealt = distinct.select("print", F.inline(deals)).repartition(partitions(distinct.sparkSession), "block", "bits").sortWithinPartitions("block", "bits", "print")
    return dealt.mapInArrow(_search(radius, most), "a long, b long").distinct()


def group_near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, most: int = 2000) -> DataFrame:
    """doc_id, print (64 bits as a long), component_id: the least doc_id reachable over links."""
    small_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, print long"), "simhash")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    groups = _groups(distinct, radius, most)
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    member = groups.select("print", "component").join(least, "component").select("print", "component_id")
    return prints.join(member, "print").select("doc_id", "print", "component_id")


def _groups(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """print, least and component (a print) of distinct fingerprints."""
    found = components(links(distinct.select("print"), radius, most))
    return distinct.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
