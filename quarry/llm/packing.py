"""Best-fit packing by length-histogram planning. Documents become pieces of at most `size` tokens; only the histogram of
piece lengths (at most `size` counts) is planned on the driver, longest first, each length into the open sequences with
the least room that fits it. The plan is a list of runs: so many pieces of one length go, in rank order, to consecutive
sequences at one offset. Pieces take their slots by an equi-join on (length, rank within length).

Ranks need no group in one task: pieces are dealt to buckets by hash, ranked within (bucket, length), and shifted by the
counts of the buckets before. Texts are encoded once, by a library's merges, which give the tokenizer's ids; the written
table of pieces cuts the lineage. Pieces that tie in document, place and ids are the same piece, whichever takes a slot.

Defined results: a null text is empty; every document ends with `end_id`, so an empty one is a piece of one token; of a
document longer than `size` tokens the first piece takes what whole pieces leave over; repeated rows are packed each; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarry.llm.bpe import encoder, in_parts
from quarry.llm.common import partitions, small_batches, written

CHUNK = 10_000


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, offset). Sequences of equal
    room are kept together in groups, so the work follows the number of distinct lengths, not of pieces."""
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences (first, how many)
    rooms: list[int] = []  # of the groups, ascending
    opened = 0

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
                take = min(n, left)
                put_back(room, first + take, n - take)
            else:  # new sequences, each filled with as many of this length as it holds
                room, first = size, opened
                take = max(1, left // (size // length))
                opened += take
            while room >= length and left >= take:
                runs.append((length, rank, take, first, size - room))
                rank, left, room = rank + take, left - take, room - length
            put_back(room, first, take)
    return runs


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that no packing can do without: by tokens, and by pieces too long to share a sequence."""
    return max(-(-sum(n * c for n, c in counts.items()) // size), sum(c for n, c in counts.items() if 2 * n > size))


def cut_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int, buckets: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a bucket by content."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, library=True)
        for batch in batches:
            for part in in_parts(batch, 1):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(text or "") + end
                    n = len(ids) // 4
                    edges = [0, *range(n % size or size, n + 1, size)]
                    rows.extend((doc_id, i, a, b - a, crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    small_batches(docs.sparkSession)
    pieces = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))


def _slots(spark: SparkSession, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """A row for each planned place: length, rank, sequence_id, offset. Long runs are unfolded in chunks."""
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "rank0", "n", "first", "offset")])
    table = spark.createDataFrame(runs, kinds).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))))
    table = table.repartition(partitions(spark), "length", "rank0", "chunk")
    table = table.withColumn("i", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, F.col("n")) - 1)))
    return table.select("length", (F.col("rank0") + F.col("i")).alias("rank"), (F.col("first") + F.col("i")).alias("sequence_id"), "offset")


def place(pieces: DataFrame, size: int) -> DataFrame:
    """pieces (written, with bucket and length) and their sequence_id and offset."""
    spark = pieces.sparkSession
    held = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    before = held.select("bucket", "length", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = W.partitionBy("bucket", "length").orderBy(*(c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns))
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(before, ["bucket", "length"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    slots = _slots(spark, plan(counts, size)).hint("merge")  # a row a piece: never broadcast
    return ranked.join(slots, ["length", "rank"]).drop("rank", "before", "bucket")


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_pieces(docs, vocabulary, size, end_id, partitions(docs.sparkSession)), "pieces")
    return place(pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
