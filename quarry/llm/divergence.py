"""How far each source of a language is from the language and from its other sources, by exact integer term shares.

Terms are integer-dictionary encoded. Tasks count the terms of their documents, Spark adds the counts up by language,
source and term, and the terms of all languages are dealt by their hash into chunks of bounded size. In a chunk a
language's kept terms (those of `least` documents or more) form one sorted array of bytes: a term's id is its place there
(searchsorted), a group's counts are one bincount, and as ids are in the order of UTF-8, ties need no look at the terms.
The divergences of a chunk come from dense vectors of its groups; sums and best terms of chunks are then merged.

With N the group's kept occurrences, V the language's kept terms and UNIT = 10**9, a share is
p = 1 + floor(UNIT * (count + 2) / (N + 2 * V)) and the divergence of a term floor((p - q)**2 / (p + q)). Shares come from a
long division in steps of 1000, so nothing overflows while N + 2 * V < 9 * 10**15; counts are added in doubles by bincount,
which is exact below 2**53. No cap on terms, sources or documents.

Defined results: null text, lang and source are empty strings; documents without terms still make their group occur; a
language without kept terms has value 0 for all pairs; ties of a rank go to the item that is first in UTF-8; repeated rows
and repeated doc_ids count once each row; very long texts are counted whole; an empty table gives no rows; other columns are
ignored. Memory of a task: CELLS counts of one chunk (a chunk of one term holds all its groups), the texts of a batch, and
the counters of HELD entries (of one text's terms more)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import small_batches
from quarry.storage import written

UNIT = 10**9
#: Rows of counts, and counts of dense vectors (terms by groups), that a chunk has on average at most.
ROWS, CELLS = 100_000, 1 << 22
#: Entries of a task's counters before they are passed on.
HELD = 1 << 17

#: Bytes of terms, A-Z lower-cased; all others separate them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of some documents; once a group a row without term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> pa.RecordBatch:
        at = [(*g, t, n, seen[1][t]) for g, seen in held.items() for t, n in seen[0].items()] + [(*g, None, 0, 0) for g in held]
        columns = list(zip(*at, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "d"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
            terms = Counter(text.as_buffer().to_pybytes().translate(TERM_BYTES).split())
            every, docs = held[lang, source]
            every.update(terms)
            docs.update(terms.keys())
        if sum(len(every) for every, _ in held.values()) > HELD:
            yield rows()
    yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary; one row without, for the group itself), n occurrences, d documents."""
    small_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = docs.select(empty("lang"), empty("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = given.mapInArrow(_count, "lang string, source string, term binary, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _encoded(least: int):
    def encode(chunk: pa.Table) -> pa.Table:
        """A row of each language with its kept terms in order, and one of each group with ids and counts."""
        at, out = chunk.column("chunk")[0].as_py(), []
        for lang in pc.unique(chunk.column("lang")).to_pylist():
            own = chunk.filter(pc.equal(chunk.column("lang"), lang))
            docs = own.group_by("term").aggregate([("d", "sum")])
            kept = np.array(sorted(docs.filter(pc.greater_equal(docs.column("d_sum"), least)).column("term").to_pylist()), object)
            if not len(kept):
                continue
            out.append((at, lang, None, kept.tolist(), None, None))
            terms, n = np.array(own.column("term").to_pylist(), object), own.column("n").to_numpy()
            ids = np.searchsorted(kept, terms)
            there = kept[np.minimum(ids, len(kept) - 1)] == terms
            sources = own.column("source").combine_chunks().dictionary_encode()
            group = sources.indices.to_numpy()
            for g, source in enumerate(sources.dictionary.to_pylist()):
                mine = there & (group == g)
                counts = np.bincount(ids[mine], weights=n[mine], minlength=len(kept)).astype(np.int64)
                some = np.flatnonzero(counts)
                out.append((at, lang, source, None, some, counts[some]))
        kinds = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "lang", "source", "terms", "ids", "counts"])

    return encode


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + 2) / whole), exactly."""
    rest, share = counts + 2, np.zeros(np.broadcast_shapes(counts.shape, whole.shape), np.int64)
    for _ in range(3):
        now, rest = np.divmod(rest * 1000, whole)
        share = share * 1000 + now
    return share + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = p - q
    return away * away // (p + q)


def _compared(top: int):
    def compare(chunk: pa.Table) -> pa.Table:
        """Sums over a chunk's terms of each two groups, and each group's first terms."""
        rows = sorted(chunk.to_pylist(), key=lambda r: (r["source"] is not None, r["source"]))
        terms, groups = rows[0]["terms"], rows[1:]
        lang, v, sources = groups[0]["lang"], groups[0]["v"], [r["source"] for r in groups]
        counts = np.zeros((len(groups), len(terms)), np.int64)
        for i, r in enumerate(groups):
            counts[i, np.array(r["ids"] or [], np.int64)] = r["counts"] or []
        sizes = np.array([r["n"] for r in groups], np.int64)
        sums, best = np.zeros((len(groups), len(groups)), np.int64), []
        step = max(1, CELLS // len(groups))
        for x in range(0, len(terms), step):
            block = counts[:, x : x + step]
            p = shares(block, sizes[:, None] + 2 * v)
            q = shares(block.sum(axis=0), np.array([groups[0]["all_n"]]) + 2 * v)
            for i in range(len(groups)):
                sums[i, i + 1 :] += divergence(p[i], p[i + 1 :]).sum(axis=1)
                ids = np.flatnonzero((block[i] > 0) & (p[i] > q))
                value = divergence(p[i, ids], q[ids])
                first = np.argsort(-value, kind="stable")[:top]  # ids are in the order of UTF-8
                best += [(lang, sources[i], "term", terms[x + ids[k]], int(value[k])) for k in first]
        pairs = [(lang, a, "pair", b.encode(), int(sums[min(i, j), max(i, j)])) for i, a in enumerate(sources) for j, b in enumerate(sources) if i != j]
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
        columns = list(zip(*pairs, *best, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    return compare


def audit(docs: DataFrame, least: int = 10, top: int = 10, chunks: int | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. chunks: how many the terms are dealt into; by default as many as
    keep a chunk within ROWS and CELLS."""
    counts = written(term_counts(docs), "term-counts")
    terms, groups = counts.filter("term IS NOT NULL"), counts.filter("term IS NULL").select("lang", "source")
    if chunks is None:
        rows = terms.count()
        most = groups.groupBy("lang").count().agg(F.max("count")).head()[0] or 1
        chunks = max(1, -(-rows // ROWS), -(-rows * most // CELLS))
    dealt = terms.withColumn("chunk", F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int"))
    kinds = "chunk int, lang string, source string, terms array<binary>, ids array<int>, counts array<long>"
    encoded = written(dealt.groupBy("chunk").applyInArrow(_encoded(least), kinds), "term-chunks")
    lists, vectors = encoded.filter("terms IS NOT NULL"), encoded.filter("terms IS NULL").drop("terms")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = vectors.groupBy("lang", "source").agg(F.sum(total("counts")).alias("n"))
    kept = lists.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    sized = groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["n"]).withColumn("all_n", F.sum("n").over(W.partitionBy("lang"))).join(kept, "lang")
    whole = lists.select("chunk", "lang").join(sized, "lang").join(vectors, ["chunk", "lang", "source"], "left")
    found = whole.unionByName(lists.select("chunk", "lang", "source", "terms"), allowMissingColumns=True)
    found = found.groupBy("chunk", "lang").applyInArrow(_compared(top), "lang string, source string, part string, item binary, value long")
    keys = ["lang", "source", "part", "item"]
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    none = others.select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    merged = found.unionByName(none).groupBy(*keys).agg(F.sum("value").alias("value"))
    nth = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    is_listed: Column = (F.col("part") == "pair") | (F.col("rank") <= top)
    return merged.withColumn("rank", nth).filter(is_listed).withColumn("item", F.col("item").cast("string"))
