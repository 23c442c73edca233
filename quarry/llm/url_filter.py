"""URL filters: a url is expanded into host-suffix and path-prefix expressions, the expressions meet the rules in an
equi-join on a short hash prefix, the full digest confirms, and the longest rule wins. Only built-in functions.

Distinct (host, path) pairs are judged once, so a hot url costs one expansion; expansions go only as deep as the deepest
rule, which loses none. Urls without host and path, which meet no rule, are judged where they are read. The rules are
broadcast while their counted bytes stay under broadcast_bytes, and joined by shuffle beyond.

Defined results: a null url or one without "://" has empty host and path and meets no rule; repeated rows are each
judged; a rule without a host fits nothing; of rules of equal length the one with the longer host wins, of equal ones the one that blocks; very long urls are
read whole; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) rows, without Python on the executors."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = 8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict."""
    folder = F.regexp_extract("path", "(?s)^.*/", 0)  # a rule is filed under its path up to the last slash
    known = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    known = known.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), _digest(F.col("host"), folder).alias("r_digest"),
        (F.size(F.split("host", r"\."))).alias("r_labels"), (F.size(F.split(folder, "/")) - 1).alias("r_depth"),
    )
    labels, depth, n, size = known.agg(F.max("r_labels"), F.max("r_depth"), F.count("*"), F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 150)).first()
    labels, depth = labels or 1, depth or 0
    side = known.select("r_host", "r_path", "r_verdict", "r_digest", F.substr("r_digest", F.lit(1), F.lit(prefix_digits)).alias("short")) if n else None

    host, path = url_host_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    if side is None:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    parts, steps = F.split("host", r"\."), F.split("path", "/", depth + 1)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size("parts") - (labels - 1)), F.size("parts")),
        lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."),
    )
    folders = F.concat(
        F.array(F.lit("")),
        F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda d: (d < F.size("steps")) & (d <= depth)),
            lambda d: F.concat(F.array_join(F.slice("steps", F.lit(1), d), "/"), F.lit("/")),
        ),
    )
    urls = pages.select("host", "path").distinct().withColumns({"parts": parts, "steps": steps})
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(folders, lambda f: _digest(h, f))))
    keyed = urls.select("host", "path", F.explode(keys).alias("digest")).withColumn("short", F.substr("digest", F.lit(1), F.lit(prefix_digits)))
    if size <= broadcast_bytes:
        side = F.broadcast(side)
    hits = keyed.join(side, "short").filter((F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    rank = F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    met = best.withColumnsRenamed({"host": "b_host", "path": "b_path"})
    asked = (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path"))
    known_url = F.col("host") != ""  # the others get no partner and are dealt by their page, not by an empty key
    left = pages.withColumn("salt", F.when(~known_url, F.xxhash64("page_id")).otherwise(F.lit(0)))
    return left.join(met.withColumn("b_salt", F.lit(0).cast("long")), asked & (F.col("salt") == F.col("b_salt")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
