"""Source divergence, importance resampling and toxicity: SQL, plain Python, held-out labels, odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import divergence_queries, importance_queries, queries, toxicity
from quarry.llm.clauses import CLASSES, Symbols, parse
from quarry.llm.common import table
from quarry.llm.divergence import audit, shares
from quarry.llm.importance import Resampling, resample
from quarry.llm.toxicity import learn, score
from tests.compare import same_as_sql
from tests.conftest import SMALL
from tests.llm.conftest import KIND

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling"])
def test_query_equals_sql(spark, name):
    same_as_sql(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL)


def plain_audit(rows, least, top):
    counts, df, out = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    for lang, source in counts:
        kept = [t for t, n in df[lang].items() if n >= least]
        of = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept]
        own, whole = of(counts[lang, source]), of(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(-sum(map(far, own, of(c))), s.encode()) for (x, s), c in counts.items() if x == lang and s != source]
        terms = [(-far(p, q), t.encode()) for t, p, q in zip(kept, own, whole, strict=True) if counts[lang, source][t] and p > q]
        out |= {(lang, source, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pairs), 1)}
        out |= {(lang, source, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("given", ["docs", "repeated", "empty"])
@pytest.mark.parametrize("chunks", [1, 7])
def test_audit_of_odd_tables(given, chunks, request):
    df = request.getfixturevalue(given)
    got = audit(df, least=2, top=5, chunks=chunks)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_audit([tuple(r) for r in df.collect()], 2, 5)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_shares_of_counts_beyond_64_bit_products():
    import numpy as np

    n, whole = 7 * 10**14, 9 * 10**14
    assert shares(np.array([n]), np.array([whole])).tolist() == [1 + 10**9 * (n + 2) // whole]


def plain_resample(rows, target, r):
    def found(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % r.buckets for k in range(1, r.longest + 1) for i in range(len(ws) - k + 1)]

    docs, s, t = [(x[0], *found(x[1])) for x in rows], Counter(), Counter()
    for _, _, at in docs:
        s.update(at)
    for x in target:
        t.update(found(x)[1])
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every_s + r.buckets) / ((s[b] + 1) * (every_t + r.buckets))))
    out = []
    for i, n, at in docs:
        h = int(hashlib.sha256(f"{r.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, at))
        out.append([i, len(at), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    may = sorted((x for x in out if x[5] >= r.least_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for rank, x in enumerate(may[: len(may) * r.percent // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("given", ["docs", "repeated", "empty"])
@pytest.mark.parametrize("longest", [1, 2])
def test_resample_odd_tables(spark, given, longest, request):
    df, r = request.getfixturevalue(given), Resampling(longest=longest, least_words=4, percent=50)
    words = ["alpha beta GAMMA delta", None, "passage of hundred", ""]
    got = resample(df, spark.createDataFrame([(w, "x") for w in words], "text string, at string"), r).collect()
    got = sorted(((x["doc_id"], x["n_features"], x["weight"], x["score"], x["rank"]) for x in got), key=repr)
    expected = plain_resample([tuple(x) for x in df.collect()], words, r)
    unranked = lambda rows: sorted((x[:4] for x in rows), key=repr)
    assert unranked(got) == unranked(expected)
    ranks = lambda rows: sorted((x[4], x[0], x[3]) for x in rows if x[4])
    assert ranks(got) == ranks(expected)


def test_grammar_of_clauses():
    symbols = Symbols({"idiot$": 4, "fool": 2})
    named = lambda text: sorted((toxicity._name(c), n) for c, n in parse(text, symbols)[1].items())
    assert named("What an IDIOT! Foolish thing") == [("insult2", 1), ("insult4", 1)]
    assert named("You idiot") == [("insult4 aimed", 1)]
    assert named("He is not an idiot") == [("insult4 denied aimed", 1)]
    assert named("not now. an idiot") == [("insult4", 1)]
    assert named("she said: idiot") == [("insult4", 1)]
    assert named("she said an idiot came") == [("insult4 reported aimed", 1)]
    assert named('"idiot" and fool') == [("insult2", 2)]
    assert named("I will kill you") == [("threat aimed", 1)]
    assert named("they kill time, will come") == []
    assert named("I will not kill you") == [("threat denied aimed", 1)]
    assert named("idiots") == named("") == named("\n.") == []
    assert parse("a. b! c " + "d " * 60, symbols)[0] == 5
    assert len(CLASSES) == 40


def test_toxicity_of_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    rows = queries.queries()["op13_toxicity"](spark, at).drop("n_clauses", "heaviest")
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, at, "labels").collect()}
    got = rows.collect()
    assert len(got) == table(spark, at, "documents").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_labels_of_held_out_documents_are_not_read(spark):
    """Turning every held-out label and all langs and sources changes no score."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, score(d, learn(d, x)).collect())) for d, x in ((docs, labels), (docs.withColumn("lang", F.lit("x")), turned)))
    assert one == two


@pytest.mark.parametrize("given", ["docs", "repeated", "empty"])
def test_toxicity_of_odd_tables(spark, given, request):
    df = request.getfixturevalue(given)
    odd = spark.createDataFrame([(None, 1), (1, None), (6, 1), (6, 0), (6, 0), (8, 0), (10, 0), (99, 1)], "doc_id long, toxic int")
    for labels in (odd, odd.limit(0)):
        got = score(df, learn(df, labels)).collect()
        assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(r["doc_id"]) for r in df.collect())
        assert all(0 <= r["score"] <= 1 for r in got)
        empty = {r["score"] for r in got if r["n_clauses"] == 0}
        assert len(empty) <= 1


def test_planted_insults_in_new_documents(spark):
    """Learned insults are found in new texts; the same texts without them are left alone."""
    plain = ["the onre thand of inglyst and oner here", "of reonat ndtion and with oneaan shha"]
    rows = [(i, p, "en", "s", 0) for i, p in enumerate(plain)] + [(10 + i, p.replace(" and ", " you moron, pathetic clown and "), "en", "s", 0) for i, p in enumerate(plain)]
    model = learn(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    got = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(rows, KIND), model).collect()}
    assert got[0] < 0.5 and got[1] < 0.5 and got[10] >= 0.7 and got[11] >= 0.7


def test_no_divergence_sql_without_tables():
    assert set(divergence_queries.ORACLES) | set(importance_queries.ORACLES) <= set(queries.queries())
