"""Language identification by prediction by partial matching. For each language a tree of byte contexts up to three bytes
long is counted from a bounded sample of labelled documents and frozen. A text is coded under every language; a byte
unseen in a context costs an escape (method C, symbols of longer contexts excluded) to the next shorter one, down to a
uniform choice among the bytes left. The language of the shortest code wins; the score is its share of the posterior.

As statistics are frozen, the cost of a byte after a context is a constant: workers unfold the counts once into a table
and a text is scored by table look-ups, in time proportional to its length.

The sample, the only part that is bounded: of every lang value, the `documents` rows of least hash (fewer where there are
so many values that they would be over `rows` in all), each cut after `longest` characters (fewer where that would be
over `characters` in all). No value is left out. Everything else covers all rows and whole texts. Workers unfold BLOCK
languages at a time, so their memory does not grow with the number of languages.

Defined results: a null text or one without a letter is 'und' with score 0, as is every text where nothing could be
learned; ties go to the first language by name; bytes that no sample has cost the uniform choice and count as the start
of a text when they are context; a null doc_id is neither held out nor learned from; repeated rows are predicted each; an
very long texts are scored whole; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import small_batches

ORDER = 3
BLOCK = 16


@dataclass(frozen=True)
class Sample:
    documents: int = 400
    longest: int = 20_000
    rows: int = 20_000
    characters: int = 32 << 20

    def of(self, languages: int) -> tuple[int, int]:
        """Documents of a language and characters of a document."""
        documents = max(1, min(self.documents, self.rows // max(1, languages)))
        return documents, max(1, min(self.longest, self.characters // max(1, documents * languages)))


@dataclass(frozen=True)
class Model:
    """names of languages; alphabet: class of each byte (0: seen in no sample); of each language, distinct runs of four
    classes as one number, and how often it has them."""

    names: tuple[str, ...]
    alphabet: bytes
    grams: tuple[bytes, ...]
    counts: tuple[bytes, ...]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _padded(texts: list[bytes], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each after ORDER zeros, and where the texts begin."""
    lens = np.array([len(t) for t in texts])
    begins = np.cumsum(lens + ORDER) - lens
    pad = bytes(ORDER)
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    out = alphabet[raw].astype(np.int64)
    for i in range(1, ORDER + 1):
        out[begins - i] = 0
    return out, begins


def _text_places(begins: np.ndarray, total: int) -> np.ndarray:
    """Indexes of text bytes, without the padding."""
    inside = np.ones(total, bool)
    for i in range(1, ORDER + 1):
        inside[begins - i] = False
    return np.flatnonzero(inside)


def _grams(classes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for i in range(ORDER, -1, -1):
        out = out * size + classes[at - i]
    return out


def train(docs: DataFrame, sample: Sample = Sample()) -> Model:
    """From text and lang of the documents that are not held out."""
    small_batches(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out() & (F.octet_length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sizes.count()
    documents, longest = sample.of(languages)
    # rows whose hash lies in twice the share that is needed: few, whatever the language's size
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / float(1 << 63)
    some = usable.join(F.broadcast(sizes) if languages <= 10_000 else sizes, "lang").filter(place * F.col("n") <= 2 * documents + 50)
    first = W.partitionBy("lang").orderBy("place", "doc_id", "text")
    cut = some.select("lang", "doc_id", F.left("text", F.lit(longest)).alias("text"), place.alias("place"))
    rows = cut.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= documents).select("lang", "text").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    names = tuple(sorted(texts))
    seen = sorted({b for ts in texts.values() for t in ts for b in t})
    alphabet = np.zeros(256, np.uint8)
    alphabet[seen] = np.arange(1, len(seen) + 1) if len(seen) < 256 else np.minimum(np.arange(1, 257), 255)
    found = {}
    for i, name in enumerate(names):
        classes, begins = _padded(texts[name], alphabet)
        grams, counts = np.unique(_grams(classes, _text_places(begins, len(classes)), int(alphabet.max()) + 1), return_counts=True)
        found[i] = grams, counts
    return Model(names, alphabet.tobytes(), *(tuple(found[i][j].astype(kind).tobytes() for i in range(len(names))) for j, kind in enumerate((np.int64, np.int32))))


class Coder:
    """The counts of some languages unfolded: bits[context, byte class, language]."""

    def __init__(self, model: Model, first: int = 0, languages: int = BLOCK):
        self.alphabet = np.frombuffer(model.alphabet, np.uint8)
        a = self.size = int(self.alphabet.max()) + 1
        own = [np.frombuffer(g, np.int64) for g in model.grams[first : first + languages]]
        grams = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
        counts = np.zeros((len(grams), len(own)), np.int32)
        for j, (g, c) in enumerate(zip(own, model.counts[first : first + languages], strict=True)):
            counts[np.searchsorted(grams, g), j] = np.frombuffer(c, np.int32)
        symbol, longest = grams % a, grams // a
        contexts = np.unique(longest)
        bits = np.empty((len(contexts) + a * a, a, len(own)), np.float32)
        self.of_context = np.full(a**ORDER, -1, np.int32)
        self.of_context[contexts] = np.arange(len(contexts))
        pairs = np.arange(a * a)
        for j in range(len(own)):
            def table(context: np.ndarray, rows: int) -> np.ndarray:
                return np.bincount(context * a + symbol, weights=counts[:, j], minlength=rows * a).reshape(rows, a)  # noqa: B023

            three = table(np.searchsorted(contexts, longest), len(contexts))
            two, one, none = table(longest % (a * a), a * a), table(longest % a, a), table(longest * 0, 1)
            bits[: len(contexts), :, j] = self._bits([three, two[contexts % (a * a)], one[contexts % a], none])
            bits[len(contexts) :, :, j] = self._bits([two, one[pairs % a], none])
        self.bits, self.known = bits.reshape(-1, len(own)), len(contexts)

    @staticmethod
    def _bits(orders: list[np.ndarray]) -> np.ndarray:
        rows, a = orders[0].shape
        p, excluded, escape = np.zeros((rows, a)), np.zeros((rows, a), bool), np.ones((rows, 1))
        for counts in orders:
            left = np.where(excluded, 0, counts)
            distinct = (left > 0).sum(axis=1, keepdims=True)
            total = np.maximum(left.sum(axis=1, keepdims=True) + distinct, 1)
            p += escape * left / total
            escape = np.where(distinct > 0, escape * distinct / total, escape)
            excluded = excluded | (counts > 0)
        rest = escape / np.maximum(256 - excluded.sum(axis=1, keepdims=True), 1)
        return -np.log2(np.where(excluded, p, rest))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; texts are not empty."""
        classes, begins = _padded(texts, self.alphabet)
        at = _text_places(begins, len(classes))
        context = _grams(classes, at - 1, self.size) % self.size**ORDER
        row = self.of_context[context]
        row = np.where(row >= 0, row, self.known + context % self.size**2)
        starts = begins - ORDER * np.arange(1, len(texts) + 1)
        return np.add.reduceat(self.bits[row * self.size + classes[at]], starts, axis=0, dtype=np.float64)


@lru_cache(maxsize=1)
def _coder(model: Model, first: int) -> Coder:
    return Coder(model, first)


def identify(model: Model, spark: SparkSession):
    """A column function of text: struct of lang_pred, score and bits (code length of the text under lang_pred)."""
    names = model.names
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("struct<lang_pred: string, score: double, bits: double>")
    def run(column):  # noqa: ANN001, ANN202
        import pandas as pd

        texts = [t or "" for t in column]
        n = len(texts)
        lang, score, bits = ["und"] * n, np.zeros(n), np.zeros(n)
        judged = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if names else []
        lengths = np.zeros((n, len(names)))
        for first in range(0, len(names) if judged else 0, BLOCK):
            for some in _parts(judged, texts):
                lengths[some, first : first + BLOCK] = _coder(sent.value, first).code_lengths([texts[i].encode() for i in some])
        if judged:
            lengths = lengths[judged]
            shortest = lengths.min(axis=1)
            score[judged] = 1 / np.exp2(np.maximum(shortest[:, None] - lengths, -1000)).sum(axis=1)
            bits[judged] = shortest
            for i, b in zip(judged, lengths.argmin(axis=1).tolist(), strict=True):
                lang[i] = names[b]
        return pd.DataFrame({"lang_pred": lang, "score": score, "bits": bits})

    return run


def _parts(rows: list[int], texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    """Rows in parts of at most so many characters (one row at least)."""
    held, size = [], 0
    for i in rows:
        if held and size + len(texts[i]) > most:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield held


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits."""
    return docs.select("doc_id", identify(model, docs.sparkSession)("text").alias("l")).select("doc_id", "l.*")


def keep(docs: DataFrame, sample: Sample = Sample(), least_score: float = 0.5, slack: float = 2.5) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the languages: by a score of at least least_score, and by
    bits a byte of at most slack times the language's median."""
    found = identify(train(docs, sample), docs.sparkSession)
    usual = {r["lang"]: r["usual"] for r in _medians(docs, found).collect()}
    fits = F.lit(True)
    if usual:
        limit = F.coalesce(F.create_map(*(F.lit(x) for kv in usual.items() for x in kv))[F.col("l.lang_pred")], F.lit(max(usual.values())))
        fits = F.col("l.bits") <= slack * limit * F.octet_length("row.text")
    return docs.select(F.struct("*").alias("row"), found("text").alias("l")).filter((F.col("l.lang_pred") != "und") & (F.col("l.score") >= least_score) & fits).select("row.*")


def _medians(docs: DataFrame, found) -> DataFrame:  # noqa: ANN001
    """lang, usual: median bits a byte of the documents that get the language of their label, of the held-out ones where there are any."""
    seen = docs.select("lang", held_out().alias("held"), F.octet_length("text").alias("size"), found("text").alias("l"))
    each = F.when(F.col("l.lang_pred") == F.col("lang"), F.col("l.bits") / F.col("size"))  # a filter would evaluate l twice
    middle = seen.groupBy("lang").agg(F.coalesce(F.percentile_approx(F.when(F.col("held"), each), 0.5), F.percentile_approx(each, 0.5)).alias("usual"))
    return middle.filter("lang IS NOT NULL AND usual IS NOT NULL")
