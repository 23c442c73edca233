"""Importance resampling towards a target: documents whose hashed word counts look like the target's are drawn.

Higher-order functions make each document's array of buckets (crc32 of a feature modulo `buckets`) inside its row. Only the
totals of buckets are shuffled, at most `buckets` rows a task. They become the gains, an array literal of `buckets` entries,
and a document's weight is an aggregate over element_at of that array: no explode, no join and no Python in scoring. A draw
without replacement adds Gumbel noise from a hash of doc_id to the weight and takes the highest scores; their ranks come from
a sort by ranges, whose counts alone (one a range) reach the driver.

Defined results: a null text has no features; a document without features has weight 0; documents under `least_words` words
are never drawn and do not count for the share; a null doc_id has the noise of the text '<seed>:' and comes first among ties;
rows of one doc_id and score stand in any order, each with a rank of its own; very long texts are read whole; an empty table
gives no rows, an empty target gains from its absence alone; other columns are ignored unless `carry` names them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions
from quarry.storage import written

CAPITALS = "".join(map(chr, range(65, 91)))
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Resampling:
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower()), GAP)
    return F.filter(parts, lambda w: w != "")


def features(found: Column, longest: int) -> Column:
    """Runs of 1 to `longest` words."""
    def runs(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found) - (k - 1), F.lit(1))), lambda i: i + (k - 1) <= F.size(found))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, k), " "))

    return found if longest == 1 else F.concat(*map(runs, range(1, longest + 1)))


def bucketed(texts: DataFrame, r: Resampling, *carry: str) -> DataFrame:
    """carry, n_words, at: the bucket of each feature."""
    found = texts.select(*carry, words(F.col("text")).alias("words"))
    at = F.transform(features(F.col("words"), r.longest), lambda w: (F.crc32(w) % r.buckets).cast("int"))
    return found.select(*carry, F.size("words").cast("long").alias("n_words"), at.alias("at"))


def totals(of: DataFrame) -> DataFrame:
    return of.select(F.explode("at").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, r: Resampling) -> list[int]:
    """floor(1000 * ln of the smoothed ratio) of each bucket."""
    spark = source.sparkSession
    both = spark.range(r.buckets).select(F.col("id").cast("int").alias("bucket")).join(totals(source).withColumnRenamed("n", "s"), "bucket", "left")
    both = both.join(totals(target).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"]).collect()
    every_s, every_t = sum(x["s"] for x in both), sum(x["t"] for x in both)
    rows = spark.createDataFrame([(x["bucket"], float(x["t"] + 1), float(x["s"] + 1)) for x in both], "bucket int, t double, s double")
    ratio = F.col("t") * F.lit(float(every_s + r.buckets)) / (F.col("s") * F.lit(float(every_t + r.buckets)))
    return [x["gain"] for x in sorted(rows.select("bucket", F.floor(F.lit(1000) * F.log(ratio)).alias("gain")).collect())]


def literal(numbers: list[int]) -> Column:
    """An array literal; a text that the optimizer folds, as one expression each number would be slow to plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def noise(doc_id: str, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, r: Resampling) -> DataFrame:
    """rank 1, 2, ... of the drawn rows (may, score, doc_id, order), others null. A range of equal scores can be split, as the row's number is the last key."""
    keys = (F.desc("may"), F.desc("score"), F.asc("doc_id"), F.asc("nth"))
    numbered = scored.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(partitions(scored.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = written(numbered.drop("nth").withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = dict(placed.filter("may").groupBy(part.alias("part")).count().collect())
    before, so_far = [], 0
    for i in range(max(sizes, default=0) + 1):
        before.append(so_far)
        so_far += sizes.get(i, 0)
    nth = F.element_at(literal(before), (part + 1).cast("int")) + F.col("place") % (1 << 33) + 1
    drawn = F.when(F.col("may"), nth)
    return placed.withColumn("rank", F.when(drawn <= so_far * r.percent // 100, drawn)).drop("may", "place")


def resample(docs: DataFrame, target: DataFrame, r: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document."""
    held = written(bucketed(docs.select("doc_id", "text"), r, "doc_id"), "buckets")
    gain = literal(gains(held, bucketed(target.select("text"), r), r))
    weight = F.aggregate("at", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1))
    scored = held.select("doc_id", "n_words", F.size("at").cast("long").alias("n_features"), weight.alias("weight"), (F.col("n_words") >= r.least_words).alias("may"))
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", r.seed))
    return ranked(written(scored, "scored"), r)
