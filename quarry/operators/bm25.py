"""BM25 as tables: postings (term, chunk_id, tf, dl) and term_stats (term, df, idf); a search touches only the postings of the
query's terms. A saved index is a pair of tables that change by batches (quarry.operators.store): a batch's postings are a
segment, what it takes out are tombstones, and statistics are sums over segments whose rows can be negative, so that only the
batch is tokenized and the index equals a rebuild.

A term's postings lie in blocks by size of tf and of dl; of each block the greatest tf and the least length are kept, which
bound what it can add to a score. search() scores the best postings of each term first, takes the k-th score found as a
threshold and then reads only blocks whose chunks can still reach it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import let, tokenize
from quarry.operators.store import Table
from quarry.storage import written

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Postings that a task sorts at once.
SORTED_ROWS = 1 << 19


def _counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of sorted tokens."""
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    one = lambda s, at: F.transform(at, lambda a, i: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - a).cast("long").alias("tf")))
    return let(tokens, lambda s: let(begins(s), lambda at: one(s, at)))


def term_counts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunk_id, dl, term, tf, and for each chunk a row without a term. Texts are tokenized once: the counts are written.
    They are counted inside the row, so no token moves; only if chunk_ids repeat are the counts added up."""
    split = chunks.select("chunk_id", F.sort_array(tokenize(F.coalesce(text, F.lit("")))).alias("tokens"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")))
    # an inner inline would have the optimizer evaluate its argument twice more, for a filter on its size
    counts = written(split.select("chunk_id", F.size("tokens").alias("dl"), F.inline_outer(F.concat(_counted(F.col("tokens")), none))), "term-counts")
    of_chunk = counts.filter("term IS NULL").agg(F.count("*").alias("n"), F.count_distinct("chunk_id", "dl").alias("distinct"), F.count_if(F.col("chunk_id").isNull()).alias("unnamed")).head()
    if of_chunk["n"] == of_chunk["distinct"] + of_chunk["unnamed"] and of_chunk["unnamed"] < 2:
        return counts
    added = counts.groupBy("chunk_id", "dl", "term").agg(F.sum("tf").alias("tf"))
    return written(added, "term-counts")


def _laid_out(postings: DataFrame, rows: int) -> DataFrame:
    """By term, block and chunk, in as many ranges as keep a task's sort small."""
    return postings.repartitionByRange(max(1, -(-rows // SORTED_ROWS)), "term", "block", "chunk_id")


def _postings(counts: DataFrame) -> DataFrame:
    level = lambda c, base: F.floor(F.log(base, F.col(c).cast("double")) + 1e-9).cast("int")
    return counts.filter("term IS NOT NULL").select("chunk_id", "term", "tf", "dl", (level("tf", 2.0) * 64 + level("dl", 2.0)).alias("block"))


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"))


def _merged(blocks: DataFrame) -> DataFrame:
    """Blocks of several segments; bounds stay bounds where postings have gone."""
    return blocks.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).filter("n <> 0")


def _frequencies(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("n").alias("df")).filter("df <> 0")


def _sizes(counts: DataFrame) -> dict:
    """How many chunks, and their length in all."""
    row = counts.filter("term IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).head()
    return {"n": row["n"], "length": row["length"]}


def _with_idf(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf: negative ones become a share of the mean."""
    raw = df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), how="cross").select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean has one row


def _corpus(spark: SparkSession, n: int, length: int) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.lit(n).cast("long").alias("n"), (F.lit(length) / F.lit(n)).alias("avgdl"))


def _tables(spark: SparkSession, path: str, ids: str = "string") -> tuple[Table, Table]:
    postings = Table(spark, f"{path}/postings", f"chunk_id {ids}, term string, tf long, dl int, block int", ("chunk_id",), order=("term", "block", "chunk_id"))
    return postings, Table(spark, f"{path}/blocks", "term string, block int, n long, most long, least int", (), order=("term", "block"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame  # one row: n, avgdl
    blocks: DataFrame | None = None  # term, block, n, most (greatest tf), least (length)
    sizes: dict | None = None

    def save(self, path: str) -> None:
        """Postings are laid out by term and chunk, so that a search skips the row groups of other terms and a frequent term
        is spread over files."""
        if not self.sizes or not self.sizes["length"]:
            raise ValueError("nothing to index")
        spark = self.postings.sparkSession
        postings, stats = _tables(spark, path, self.postings.schema["chunk_id"].dataType.simpleString())
        postings.rollback(0)
        stats.rollback(0)
        postings.replace(_laid_out(self.postings, self.postings.count()), self.sizes)
        stats.replace(_blocks(postings.read()), self.sizes)  # sorted rows: a task adds most of a block up before it moves

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
        """Of a version, by default the last that both tables have."""
        postings, stats = _tables(spark, path)
        there = set(postings.versions()) & set(stats.versions())
        version = max(there, default=0) if version is None else version
        if version not in there:
            raise ValueError(f"no index of version {version} under {path}")
        facts, parts = stats.facts(version), stats.read(version)
        first = next(s for s in postings.segments(version) if s.kind == "rows")
        ids = spark.read.parquet(f"{path}/postings/rows/{first.name}").schema["chunk_id"].dataType.simpleString()
        rows = _tables(spark, path, ids)[0].read(version)
        return Index(rows, _with_idf(_frequencies(parts), facts["n"]), _corpus(spark, facts["n"], facts["length"]), _merged(parts), facts)


def build(chunks: DataFrame, text: str = "text") -> Index:
    """chunks: chunk_id and a text column."""
    counts = term_counts(chunks, text)
    sizes, postings = _sizes(counts), _postings(counts)
    blocks = _blocks(postings)
    return Index(postings, _with_idf(_frequencies(blocks), sizes["n"]), _corpus(chunks.sparkSession, sizes["n"], sizes["length"]), blocks, sizes)


def update(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame, after: int | None = None) -> int:
    """Takes the chunks `gone` (chunk_id, text as it was indexed) out and puts `fresh` (chunk_id, text) in; returns the
    version. Only these texts are tokenized. after: the version that this one follows; later ones, which a job that died
    has left, are forgotten. A chunk_id of fresh that is stored must be in gone as well."""
    ids = fresh.schema["chunk_id"].dataType.simpleString()
    postings, stats = _tables(spark, path, ids)
    after = min(max(t.versions(), default=0) for t in (postings, stats)) if after is None else after
    for t in (postings, stats):
        t.rollback(after)
    come, go = term_counts(fresh), term_counts(gone)
    plus, minus = _sizes(come), _sizes(go)
    facts = {k: plus[k] - minus[k] for k in plus}
    rows = _postings(come)
    made = postings.write(_laid_out(rows, rows.count()), {"chunk_id": go.filter("term IS NULL").select(F.col("chunk_id").alias("key"))} if minus["n"] else None, facts)
    stats.write(_blocks(postings.rows_of(made)).unionByName(_blocks(_postings(go)).withColumn("n", -F.col("n"))), facts=facts)
    return max(postings.versions())


def compact(spark: SparkSession, path: str, ids: str = "string", **how) -> int:  # noqa: ANN003
    """Merges segments (Table.compact) and adds the statistics up."""
    postings, stats = _tables(spark, path, ids)
    merged = postings.compact(**how)
    if merged:
        stats.replace(_merged(stats.read()), stats.facts())
    return merged


def _gain(tf: str, dl: str) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col("avgdl")))


def _asked(index: Index, queries: DataFrame, text: str, broadcast_terms: int) -> tuple[DataFrame, bool]:
    """query_id, term, qtf, idf of the indexed terms, and whether they are few enough to be sent to every task."""
    terms = queries.select("query_id", F.explode(tokenize(F.coalesce(text, F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    few = (queries.agg(F.sum(F.length(text))).first()[0] or 0) <= 2 * broadcast_terms  # a term takes two characters at least
    return written(terms.join(index.term_stats.select("term", "idf"), "term").select("query_id", "term", "qtf", "idf"), "asked-terms"), few


def scores(index: Index, queries: DataFrame, text: str = "text", broadcast_terms: int = 200_000) -> DataFrame:
    """query_id, chunk_id, score for every chunk that shares a term; a repeated query term counts each time. Where the terms
    are few, the postings move once, to their chunk, however many queries ask for them, and are added up there."""
    asked, few = _asked(index, queries, text, broadcast_terms)
    if few:
        postings = index.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select("chunk_id", "term", "tf", "dl")
        met = postings.repartition("chunk_id").join(F.broadcast(asked), "term")
    else:
        met = index.postings.join(asked, "term")
    met = met.join(F.broadcast(index.corpus), how="cross")
    return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("idf") * _gain("tf", "dl")).alias("score"))


def search(index: Index, queries: DataFrame, k: int, text: str = "text", first: int = 64, broadcast_terms: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """What top_k(scores(...), k) finds, in two rounds; and of each query how many blocks and postings its terms have and how
    many were read (query_id, blocks, blocks_read, postings, postings_read). broadcast_terms: so many different terms are sent
    to every task.

    The first round scores the best `first` postings (k at least) of each term, which are picked once a term, not once a
    query. Its k-th score is the threshold. Terms are put in order, the one with the fewest postings first, so that a frequent
    term has few terms after it, even where a rare one can add less (its chunks are long). A chunk is met by the first of them
    that it has, so its score is at most the bound of its block there and the greatest bounds of the terms after it; blocks for
    which that is under the threshold are not read. A chunk that has the last term alone is outdone by the best of that term,
    unless some weight is negative, so the blocks of the last, most frequent term are not read at all. What is met is scored
    by a look at its postings of the query's terms."""
    if k <= 0:
        raise ValueError("k must be positive")
    asked, _ = _asked(index, queries, text, broadcast_terms)
    terms = written(asked.select("term", "idf").distinct(), "terms")
    sent = F.broadcast(terms) if terms.count() <= broadcast_terms else terms
    avgdl = F.broadcast(index.corpus.select("avgdl"))
    mine = written(index.postings.join(sent, "term").join(avgdl, how="cross").select("term", "block", "chunk_id", "tf", "dl", _gain("tf", "dl").alias("gain"), (F.col("idf") * _gain("tf", "dl")).alias("value")), "asked-postings")
    best = written(_best(mine, max(k, first)), "best-postings")
    of = W.partitionBy("query_id")

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(asked, "query_id").join(mine.select("term", "chunk_id", "gain"), ["term", "chunk_id"])
        return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("gain")).alias("score"))

    early = written(scored(asked.join(best, "term").select("query_id", "chunk_id").distinct()), "early-scores")
    kth = early.withColumn("nth", F.row_number().over(of.orderBy(F.desc("score")))).filter(F.col("nth") == k).select("query_id", (F.col("score") - 1e-6).alias("least_score"))

    most = F.greatest(F.col("idf") * _gain("most", "least"), F.lit(0.0))
    blocks = index.blocks.join(sent, "term", "left_semi").join(sent, "term").join(avgdl, how="cross").select("term", "block", "n", most.alias("most"))
    blocks = written(blocks, "asked-blocks")
    taken = best.groupBy("term").agg(F.count("*").alias("taken"))
    of_term = blocks.groupBy("term").agg(F.max("most").alias("top"), F.sum("n").alias("df")).join(taken, "term")
    order = of.orderBy("df", "term")
    placed = asked.join(of_term, "term").withColumn("top", F.col("qtf") * F.col("top"))
    placed = placed.withColumn("after", F.coalesce(F.sum("top").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0)))
    placed = placed.withColumn("sealed", F.lead("term").over(order).isNull() & (F.min("idf").over(of) >= 0)).join(kth, "query_id", "left")
    reach = F.col("qtf") * F.col("most") + F.col("after")
    judged = placed.join(blocks, "term").withColumn("read", ~F.col("sealed") & F.coalesce(reach >= F.col("least_score"), F.lit(True)))
    judged = written(judged.select("query_id", "term", "block", "n", "taken", "read"), "read-blocks")
    report = judged.groupBy("query_id", "term").agg(F.count("*").alias("blocks"), F.count_if("read").alias("blocks_read"), F.sum("n").alias("postings"), (F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)) + F.first("taken")).alias("postings_read"))
    report = report.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("blocks", "blocks_read", "postings", "postings_read")))

    met = judged.filter("read").join(mine.select("term", "block", "chunk_id"), ["term", "block"]).select("query_id", "chunk_id").distinct()
    late = scored(met.join(early.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
    return top_k(early.unionByName(late), k), report


def _best(postings: DataFrame, k: int) -> DataFrame:
    """term, chunk_id: of each term the postings (term, chunk_id, tf, dl, value) of the k greatest values, and those that are as
    good as the k-th but for rounding; of equal tf and dl, the first k chunk_ids."""
    alike = postings.withColumn("nth", F.row_number().over(W.partitionBy("term", "tf", "dl").orderBy("chunk_id"))).filter(F.col("nth") <= k)
    placed = alike.withColumn("nth", F.row_number().over(W.partitionBy("term").orderBy(F.desc("value"))))
    placed = placed.withColumn("kth", F.max(F.when(F.col("nth") == k, F.col("value"))).over(W.partitionBy("term")))
    return placed.filter(F.col("kth").isNull() | (F.col("value") >= F.col("kth") - 1e-6)).select("term", "chunk_id")


def top_k(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """query_id, rank, key, score: scores equal to nine digits are ordered by key."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
