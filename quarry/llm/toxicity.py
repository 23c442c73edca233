"""Toxicity by a weighted finite-state grammar of clauses (quarry.llm.clauses) whose lexicon and weights are learned.

1. Lexicon: of each word and word beginning, how many toxic and other documents have it. Those that are significantly (by
   likelihood ratio) and at least e times as frequent in toxic ones are insults, in four tiers by that ratio.
2. Weights: a class of clauses weighs the log of the rate of its events in toxic over that in other documents, drawn towards the
   weight of its tier (halved if denied or reported), and that towards none. Clauses are parsed with a lexicon that was
   learned without their fold of documents, so a word that is frequent by chance earns no weight.
3. Score: a logistic function of the weights of a document's matched clauses (sum over their events, heaviest clause, sum a clause), fitted by Newton steps,
   each one aggregation, with a ridge towards DEFAULT.

Learned from at most about `toxic_rows` and `other_rows` labels, chosen by hash (all where there are fewer; documents with a
repeated doc_id all count), and at most `entries` atoms by significance. Everything else covers all rows and whole texts;
scoring is one map without a shuffle.

Defined results: a null text is empty, an empty text or one without matches has the score of no evidence; a null doc_id is
neither held out nor learned from; a doc_id with several labels is toxic if one says so, null labels are ignored; repeated
rows are scored each; ties of significance go to the first atom by name; without any toxic label the score comes from DEFAULT
and threats alone; very long texts are parsed whole, in clauses of at most 25 words; empty tables give no rows; other columns
are ignored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.clauses import CLASSES, THREAT, TIERS, TOKEN, Symbols, atoms, parse
from quarry.llm.common import small_batches
from quarry.storage import written

FOLDS = 4


@dataclass(frozen=True)
class Learning:
    toxic_rows: int = 20_000
    other_rows: int = 40_000
    entries: int = 20_000
    #: Least toxic documents and least likelihood ratio (G squared) of an atom, over the whole sample.
    support: int = 3
    significance: float = 12.0
    #: Lower bounds of the tiers, as logs of the ratio of frequencies.
    tiers: tuple[float, ...] = (1.0, 2.0, 3.0, 4.5)
    #: Weight, in clauses, of what a class's weight is drawn to; and of the ridge.
    pull: float = 10.0
    ridge: float = 0.5
    newton: int = 12


#: The logistic function's coefficients before anything is learned: constant, log of the sum, heaviest clause, log of the share.
DEFAULT = (-6.0, 1.5, 0.0, 1.0)
#: The weight of a threat before anything is learned.
THREAT_WEIGHT = 4.0


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, int]
    weights: tuple[float, ...]
    coefficients: tuple[float, ...]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(atom, slot, documents); slot: twice the fold, 1 more if toxic."""
    for batch in batches:
        held: Counter = Counter()
        for text, slot in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            held.update((a, slot) for a in {a for w in set(TOKEN.findall(text.lower())) for a in atoms(w)})
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(held.values()), pa.int64())], ["atom", "slot", "n"])


def _learned_from(docs: DataFrame, labels: DataFrame, how: Learning) -> DataFrame:
    """text, toxic, fold, weight (how many of the labels a row stands for)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, most / max(1, n.get(t, 0))) for t, most in ((0, how.other_rows), (1, how.toxic_rows))}
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    wanted = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    some = known.filter(place <= wanted).select("doc_id", "toxic", (1 / wanted).alias("weight"))
    text = F.coalesce(F.col("text"), F.lit(""))
    # at most about toxic_rows + other_rows labels of 24 bytes: their number is bounded by the parameters
    rows = docs.select("doc_id", text.alias("text")).filter(~held_out()).join(F.broadcast(some), "doc_id")
    return rows.select("text", "toxic", "weight", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))


def _lexicon(counts: DataFrame, sizes: dict[int, int], how: Learning, without: int | None = None) -> dict[str, int]:
    """Atom -> tier, from the documents outside of a fold."""
    folds = [f for f in range(FOLDS) if f != without]
    n1, n0 = (sum(sizes.get(2 * f + t, 0) for f in folds) for t in (1, 0))
    if not n1 or not n0:
        return {}
    share = (n1 + n0) / max(1, sum(sizes.values()))
    at = lambda t: sum((F.col(f"n{2 * f + t}") for f in folds), F.lit(0))
    of = counts.select("atom", at(1).alias("d1"), at(0).alias("d0")).filter(F.col("d1") >= max(2.0, how.support * share))
    ratio = F.log((F.col("d1") + 0.5) / (n1 + 1.0) / ((F.col("d0") + 0.5) / (n0 + 1.0)))
    whole, all_docs = F.col("d1") + F.col("d0"), float(n1 + n0)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    g2 = 2 * sum((part(s, e * n / all_docs) for s, e, n in ((F.col("d1"), whole, n1), (F.col("d0"), whole, n0), (n1 - F.col("d1"), all_docs - whole, n1), (n0 - F.col("d0"), all_docs - whole, n0))), F.lit(0.0))
    tier = sum(((F.col("ratio") >= t).cast("int") for t in how.tiers), F.lit(0))
    rows = of.withColumn("ratio", ratio).withColumn("g2", g2).filter((F.col("ratio") >= how.tiers[0]) & (F.col("g2") >= how.significance * share))
    return {r["atom"]: r["tier"] for r in rows.select("atom", tier.alias("tier"), "g2").orderBy(F.desc("g2"), "atom").limit(how.entries).collect()}


def _parsed(lexicons: list[dict[str, int]]):
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = [Symbols(x) for x in lexicons]
        for batch in batches:
            texts, toxic, weight, folds = (batch.column(i).to_pylist() for i in range(4))
            found = [parse(t, symbols[f]) for t, f in zip(texts, folds, strict=True)]
            classes = pa.array([list(c) for _, c in found], pa.list_(pa.int32()))
            counts = pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(weight, pa.float64()), pa.array([n for n, _ in found], pa.int64()), classes, counts], ["toxic", "weight", "clauses", "classes", "counts"])

    return parsed


def _weights(parsed: DataFrame, how: Learning) -> tuple[float, ...]:
    each = parsed.select("toxic", F.explode(F.arrays_zip("classes", "counts")).alias("x")).groupBy("toxic", "x.classes").agg(F.sum("x.counts").alias("n")).collect()
    whole = {r["toxic"]: r["n"] or 0 for r in parsed.groupBy("toxic").agg(F.sum("clauses").alias("n")).collect()}
    n = {(r["toxic"], r["classes"]): r["n"] for r in each}

    def weight(classes: list[int], towards: float) -> float:
        n1, n0 = (sum(n.get((t, c), 0) for c in classes) for t in (1, 0))
        own = math.log((n1 + 0.5) / (whole.get(1, 0) + 1) / ((n0 + 0.5) / (whole.get(0, 0) + 1)))
        return ((n1 + n0) * own + how.pull * towards) / (n1 + n0 + how.pull)

    tier = {e: weight([i for i, c in enumerate(CLASSES) if c[0] == e], THREAT_WEIGHT if e == THREAT else 0.0) for e in range(TIERS + 1)}
    return tuple(weight([i], tier[c[0]] * (0.5 if c[1] else 1) * (0.5 if c[2] else 1)) for i, c in enumerate(CLASSES))


def features(total, heaviest, clauses, log=np.log1p):
    """What the logistic function sees, of numbers, arrays or columns."""
    return total * 0 + 1.0, log(total), heaviest, log(total * 100 / clauses)


def _fitted(parsed: DataFrame, weights: tuple[float, ...], how: Learning) -> tuple[float, ...]:
    """Newton steps of the logistic regression: each sums gradient and curvature over all rows."""
    literal = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    each = F.zip_with("classes", "counts", lambda c, n: F.element_at(literal, c + 1) * n)
    total = F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x))
    heaviest = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("classes", lambda c: F.element_at(literal, c + 1))), F.lit(0.0)))
    rows = parsed.select("toxic", "weight", total.alias("total"), heaviest.alias("heaviest"), F.greatest(F.col("clauses"), F.lit(1)).alias("clauses"))
    x = [f"x{i}" for i in range(len(DEFAULT))]
    rows = rows.select("toxic", "weight", *(f.alias(c) for f, c in zip(features(F.col("total"), F.col("heaviest"), F.col("clauses"), F.log1p), x, strict=True)))
    rows = written(rows.groupBy("toxic", "weight", *x).agg(F.count("*").alias("rows")), "toxicity-fit")
    b0 = b = np.array(DEFAULT)
    for _ in range(how.newton):
        p = 1 / (1 + F.exp(-sum((F.col(c) * float(v) for c, v in zip(x, b, strict=True)), F.lit(0.0))))
        at = rows.withColumn("p", p).withColumn("w", F.col("weight") * F.col("rows"))
        first = [F.sum(F.col("w") * (F.col("toxic") - F.col("p")) * F.col(c)) for c in x]
        second = [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * F.col(c) * F.col(d)) for i, c in enumerate(x) for d in x[i:]]
        sums = [v or 0.0 for v in at.agg(*(s.alias(f"s{i}") for i, s in enumerate([*first, *second]))).head()]
        curve = np.zeros((len(x), len(x)))
        curve[np.triu_indices(len(x))] = sums[len(x) :]
        curve = curve + curve.T - np.diag(np.diag(curve)) + how.ridge * np.eye(len(x))
        step = np.linalg.solve(curve, np.array(sums[: len(x)]) - how.ridge * (b - b0))
        b = b + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> Model:
    small_batches(docs.sparkSession)
    rows = written(_learned_from(docs, labels, how), "toxicity-sample")
    slot = (2 * F.col("fold") + F.col("toxic")).cast("int")
    sizes = dict(rows.groupBy(slot.alias("slot")).count().collect())
    slots = range(2 * FOLDS)
    counts = rows.select("text", slot.alias("slot")).mapInArrow(_count, "atom string, slot int, n long")
    counts = written(counts.groupBy("atom").agg(*(F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in slots)), "toxicity-atoms")
    lexicons = [_lexicon(counts, sizes, how, f) for f in range(FOLDS)]
    kinds = "toxic int, weight double, clauses long, classes array<int>, counts array<long>"
    parsed = written(rows.select("text", "toxic", "weight", "fold").mapInArrow(_parsed(lexicons), kinds), "toxicity-clauses")
    weights = _weights(parsed, how)
    return Model(_lexicon(counts, sizes, how), weights, _fitted(parsed, weights, how))


def _scored(model: Model):
    weights, b = np.array(model.weights), np.array(model.coefficients)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(model.lexicon)
        for batch in batches:
            n, (total, heaviest, clauses, best) = batch.num_rows, np.zeros((4, batch.num_rows))
            for i, text in enumerate(batch.column(1).to_pylist()):
                clauses[i], found = parse(text or "", symbols)
                own = [(float(weights[c]), c) for c in found]
                total[i] = sum(weights[c] * k for c, k in found.items())
                heaviest[i], best[i] = max(own, default=(0.0, -1))
            x = features(np.maximum(total, 0), np.maximum(heaviest, 0), np.maximum(clauses, 1))
            score = 1 / (1 + np.exp(-np.clip(sum(c * v for c, v in zip(x, b, strict=True)), -700, 700)))
            said = pa.array([_name(int(c)) if c >= 0 else None for c in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(clauses.astype(np.int64)), said], ["doc_id", "score", "n_clauses", "heaviest"]) if n else pa.RecordBatch.from_pylist([])

    return scored


def _name(c: int) -> str:
    event, denied, reported, aimed = CLASSES[c]
    return " ".join(["threat" if event == THREAT else f"insult{event}", *(n for n, on in (("denied", denied), ("reported", reported), ("aimed", aimed)) if on)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_clauses, heaviest (the class of the heaviest clause, or null) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double, n_clauses long, heaviest string")
