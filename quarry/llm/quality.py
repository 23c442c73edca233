"""Quality rules: base rules on counts, then robust multivariate outliers. A minimum-covariance-determinant estimate per
language and source rejects documents whose transformed statistics lie too far by Mahalanobis distance. A group of fewer
than min_group documents is judged by the estimate of its language, a language of so few by that of all documents (of any
number), so every document that passes the base rules is judged. Only built-in functions.

The estimate has three starts (distances from the medians in fixed units, from the medians in median absolute deviations,
and by the mean and covariance of all). From each, concentration steps take the nearest half of a group, whose mean and
covariance give the next distances, until no half changes or after `steps`; of all estimates the one of least determinant
counts. Which half is read off a histogram of log distances, one row per group, start and bin, so each step is one
aggregation with map-side sums over all documents, whatever the group's size. Statistics are whole multiples of 1/10000,
so all sums are exact and no result depends on the order of rows.

Defined results: a null or empty text has no words and fails the base rules; a null lang or source is a group of its own;
very long texts are counted whole; equal determinants go to the first start, and equal distances to the same half;
repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import SPACES, identified, settled, without, written
from quarry.llm.words import covered_by_repeats, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
UNIT = 10_000
FEATURES = ("x1", "x2", "x3", "x4", "x5")
N = len(FEATURES)
PAIRS = [(a, b) for a in range(N) for b in range(a + 1)]
STARTS = 3


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Standard deviations added to every estimate: word length (log), symbols a word (log), shares of capitals, of
    #: repeated words and of repeated lines. Without them constant statistics would make every difference an outlier. Under
    #: them a repeated line or two reject nothing; repeated words alone are left to the base rule.
    floors: tuple[float, float, float, float, float] = (0.15, 0.03, 0.03, 0.06, 0.12)
    #: Makes the covariance of the nearest half of a five-dimensional normal that of the whole.
    consistency: float = 1.92
    #: Squared distance; a normal vector of five exceeds it twice in a billion.
    cutoff: float = 49.0
    min_group: int = 50
    steps: int = 4
    bins: int = 20
    #: Up to so many groups (one row each) their estimates are broadcast; beyond, joined by shuffle.
    broadcast_groups: int = 20_000


def statistics(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals and base_failed in a struct `q`."""
    whole = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("q_words", words(F.col("text")))
    docs = docs.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    at = lambda i: F.get(F.col("q_hashes"), i)
    keys = F.when(F.size("q_hashes") >= rules.window, F.transform(F.sequence(F.lit(0), F.size("q_hashes") - rules.window), lambda i: F.xxhash64(*(at(i + j) for j in range(rules.window))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    docs = docs.withColumns({"q_keys": keys, "q_lines": lines})
    docs = docs.withColumn(
        "q",
        F.struct(
            F.size("q_words").cast("long").alias("n_words"),
            F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
            F.size("q_lines").cast("long").alias("n_lines"),
            covered_by_repeats(F.col("q_keys"), rules.window).alias("n_repeat_words"),
            (F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))).cast("long").alias("capitals"),
        ),
    ).drop("q_words", "q_hashes", "q_keys", "q_lines")
    failed = (F.col("q.n_words") < rules.min_words) | (100 * F.col("q.n_repeat_words") > rules.max_repeat_percent * F.col("q.n_words"))
    return docs.withColumn("q", F.col("q").withField("base_failed", failed))


def _vector() -> dict[str, Column]:
    n, chars = F.greatest(F.col("q.n_words"), F.lit(1)), F.greatest(F.col("q.word_chars"), F.lit(1))
    x = (F.log(chars / n), F.log(1 + F.col("q.n_symbols") / n), F.col("q.capitals") / chars, F.col("q.n_repeat_words") / n, F.col("q.n_dup_lines") / F.greatest(F.col("q.n_lines"), F.lit(1)))
    return {f: F.round(v * UNIT).cast("long") for f, v in zip(FEATURES, x, strict=True)}


def _with_distance(df: DataFrame, name: str = "far") -> DataFrame:
    """df with the squared distance, by forward substitution with the Cholesky factor in the struct p."""
    solved = [f"({f} / {UNIT} - p.m{i}" + "".join(f" - p.l{i}{j} * y{j}" for j in range(i)) + f") / p.l{i}{i} AS y{i}" for i, f in enumerate(FEATURES)]
    return df.selectExpr("*", *solved, " + ".join(f"y{i} * y{i}" for i in range(N)) + f" AS {name}").drop(*(f"y{i}" for i in range(N)))


def _factor(sums: DataFrame, consistency: float, rules: QualityRules) -> DataFrame:
    """group, start, n, p (means and the Cholesky factor of the scaled covariance plus the floors) and its log determinant."""
    floor = lambda a, b: rules.floors[a] ** 2 if a == b else 0.0
    said = [f"CAST(s{i} AS double) / n / {UNIT} AS m{i}" for i in range(N)]
    for i in range(N):
        for j in range(i + 1):
            said.append(f"(CAST(s{i}{j} AS double) / n / {UNIT} / {UNIT} - m{i} * m{j}) * {consistency}D + {floor(i, j)}D AS c{i}{j}")
            rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            said.append(f"sqrt(greatest({rest}, 1e-12D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    parts = [*(f"m{i}" for i in range(N)), *(f"l{a}{b}" for a, b in PAIRS)]
    det = " + ".join(f"ln(l{i}{i})" for i in range(N))
    return sums.selectExpr("group", "start", "n", *said).selectExpr("group", "start", "n", f"struct({', '.join(parts)}) AS p", f"round({det}, 6) AS det")


#: Exact sums of the features and of their products.
SUMS = ["count(*) AS n", *(f"sum(CAST({f} AS decimal(38,0))) AS s{i}" for i, f in enumerate(FEATURES)), *(f"sum(CAST({FEATURES[a]} * {FEATURES[b]} AS decimal(38,0))) AS s{a}{b}" for a, b in PAIRS)]


def _nearest_half(fit: DataFrame, rules: QualityRules) -> DataFrame:
    """Sums over the histogram bins of the distance `far` of each group and start up to the one that completes half of its
    documents."""
    by_bin = fit.withColumn("bin", F.expr(f"CAST(floor({rules.bins} * ln(far + 1e-3D)) AS long)")).groupBy("group", "start", "bin").agg(*map(F.expr, SUMS))
    upto = by_bin.selectExpr("*", "sum(n) OVER (PARTITION BY group, start ORDER BY bin) - n AS before", "sum(n) OVER (PARTITION BY group, start) AS whole").filter("2 * before < whole")
    return upto.groupBy("group", "start").agg(*(F.expr(f"sum({c}) AS {c}") for c in ("n", *(f"s{i}" for i in range(N)), *(f"s{a}{b}" for a, b in PAIRS))))


def _medians(fit: DataFrame, values: list[Column], name: str) -> DataFrame:
    """Exact, by one aggregation over counts of distinct values (whole numbers of a bounded range)."""
    middle = lambda i: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY v{i})").cast("long").alias(f"{name}{i}")
    return fit.select("group", *(v.alias(f"v{i}") for i, v in enumerate(values))).groupBy("group").agg(*(middle(i) for i in range(N)))


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where none was judged) and kept."""
    return _judged(docs.select("doc_id", "text", "lang", "source", F.lit(0).alias("row")), rules).select("doc_id", "q.*", "distance", "kept")


def keep(docs: DataFrame, rules: QualityRules = QualityRules(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """The kept rows of docs, all columns. What is written on the way holds statistics only, no texts."""
    rows = identified(docs)
    asked = rows.select("row.doc_id", "row.text", "row.lang", "row.source", F.col("uid").alias("row"))
    gone = settled(lambda: _judged(asked, rules).filter(~F.coalesce("kept", F.lit(False))).select(F.col("row").alias("uid")), "quality-gone")
    return without(rows, gone, broadcast_rows)


def _judged(docs: DataFrame, rules: QualityRules) -> DataFrame:
    keys = {"fine": F.to_json(F.struct("lang", "source")), "coarse": F.to_json(F.struct("lang"))}
    table = statistics(docs, rules).withColumns(keys).drop("text", "lang", "source")
    return judged(written(table.withColumns(_vector()), "quality"), rules)


def estimates(fit: DataFrame, near_by, rules: QualityRules) -> DataFrame:  # noqa: ANN001
    """group and p of least determinant. fit: group and features; near_by marks a small side of a join."""
    middle = written(_medians(fit, [F.col(f) for f in FEATURES], "med"), "quality-medians")
    off = fit.join(near_by(middle), "group")
    spread = _medians(off, [F.abs(F.col(f) - F.col(f"med{i}")) for i, f in enumerate(FEATURES)], "mad")
    middle = written(middle.join(spread, "group"), "quality-spread")
    whole = _factor(fit.groupBy("group").agg(*map(F.expr, SUMS)).withColumn("start", F.lit(2)), 1.0, rules).select("group", "p")
    begin = written(middle.join(whole, "group"), "quality-starts")
    scale = lambda i, k: f"{UNIT * rules.floors[i]}D" + f" + mad{i}" * k
    apart = [" + ".join(f"pow(({f} - med{i}) / ({scale(i, k)}), 2)" for i, f in enumerate(FEATURES)) for k in (0, 1)]
    each = _with_distance(fit.join(near_by(begin), "group"), "d2").selectExpr("group", *FEATURES, f"posexplode(array({apart[0]}, {apart[1]}, d2)) AS (start, far)")
    params = written(_factor(_nearest_half(each, rules), rules.consistency, rules), "quality-step")
    known, starts = [params], F.array(*(F.lit(i) for i in range(STARTS)))
    for _ in range(rules.steps - 1):
        each = fit.withColumn("start", F.explode(starts)).join(near_by(params), ["group", "start"])
        nearer = written(_factor(_nearest_half(_with_distance(each), rules), rules.consistency, rules), "quality-step")
        same = nearer.join(params.select("group", "start", F.col("n").alias("m"), F.col("det").alias("d")), ["group", "start"]).filter("m <> n OR d <> det").isEmpty()
        params = nearer
        known.append(params)
        if same:
            break
    every = known[0].withColumn("step", F.lit(0))
    for i, one in enumerate(known[1:], 1):
        every = every.unionByName(one.withColumn("step", F.lit(i)))
    return every.groupBy("group").agg(F.min_by("p", F.struct("det", "start", "step")).alias("p"))


def judged(table: DataFrame, rules: QualityRules) -> DataFrame:
    """Adds distance and kept to a written table of statistics."""
    levels = [F.concat(F.lit("f"), "fine"), F.concat(F.lit("c"), "coarse"), F.lit("a")]
    fit = table.filter(~F.col("q.base_failed")).select(F.explode(F.array(*levels)).alias("group"), *FEATURES)
    sizes = fit.groupBy("group").agg(F.count("*").alias("size")).filter((F.col("size") >= rules.min_group) | (F.col("group") == "a")).select("group")
    sizes = written(sizes, "quality-groups")
    few = sizes.count() <= rules.broadcast_groups
    near_by = (lambda df: F.broadcast(df)) if few else (lambda df: df)  # so a group of very many documents stays where it is read
    params = written(estimates(fit.join(near_by(sizes), "group", "left_semi"), near_by, rules), "quality-fit")
    near, wide = (params.select(F.substr("group", F.lit(2)).alias(k), F.col("p").alias(f"p_{k}")).filter(F.col("group").startswith(c)) for k, c in (("fine", "f"), ("coarse", "c")))
    whole = params.filter("group = 'a'").select(F.col("p").alias("p_all"))  # one row, none if nothing passes the base rules
    out = table.join(near_by(near), "fine", "left").join(near_by(wide), "coarse", "left").join(F.broadcast(whole), F.lit(True), "left")
    out = _with_distance(out.withColumn("p", F.coalesce("p_fine", "p_coarse", "p_all")))
    out = out.withColumn("distance", F.when(~F.col("q.base_failed"), F.col("far")))
    return out.withColumn("kept", ~F.col("q.base_failed") & (F.col("distance") <= rules.cutoff))
