"""Order MinHash fingerprints: k-mers numbered by occurrence, the l smallest hashes of each bin kept in text order and
hashed as a tuple, so that the share of equal tuples falls with edit distance. Only built-in functions.

K-mers are runs of k units. A unit is a word; of a run of over LONGEST characters without white space (scripts without
spaces, long tokens) the first LONGEST characters are a unit and each further character is one, so that an edit in such a
run changes only the k-mers around it.

One permutation serves all components: a hash deals the numbered k-mers to m bins and orders them in each. A text of n
units costs a sort of n numbers inside its row (two more where k-mers repeat); the result holds at most m entries. A fingerprint is its entries in
bin order, six hex digits each (two for the bin, four for the tuple). Likeness is the share of equal entries among the
bins that either text fills.

Defined results: a null text is empty; a text without words has an empty fingerprint, and two empty ones are alike (1.0);
a text with fewer than k units is one k-mer; equal texts have equal fingerprints; very long texts are taken whole;
with_next orders by doc_id (null first), then by text; repeated rows are documents of their own; the next document of the
last is the first, of a single document itself; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import SPACES, WORD_GAP, partitions
from quarry.llm.words import bisect, words

LONGEST = 16
INSIDE = "[^\\x20\\x09-\\x0D]"


def units(text: Column) -> Column:
    """Words, and the characters of long runs past their first LONGEST."""
    bare = F.btrim(text, F.lit(SPACES))
    cut = F.split(bare, f"{WORD_GAP}|(?<={INSIDE}{{{LONGEST}}})(?={INSIDE})")
    return F.when(F.rlike(text, F.lit(f"{INSIDE}{{{LONGEST + 1}}}")), cut).otherwise(words(text))


def _numbered(kmers: Column) -> Column:
    """Hashes of the k-mers and their occurrence numbers, in text order. An occurrence number is the distance to the first
    equal k-mer in sorted order; texts without repeated k-mers, the most, need no sort for it."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluates value once

    def of_sorted(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            again = F.coalesce(F.get(s, i - 1)["kmer"] == x["kmer"], F.lit(False))
            first = bisect(s, lambda y: y["kmer"] < x["kmer"]) + 1
            return F.struct(x["at"].alias("at"), F.xxhash64(x["kmer"], F.when(again, i - first).otherwise(F.lit(0))).alias("hash"))

        return F.transform(F.sort_array(F.transform(s, one)), lambda x: x["hash"])

    placed = F.sort_array(F.transform(kmers, lambda k, i: F.struct(k.alias("kmer"), i.alias("at"))))
    single = F.transform(kmers, lambda k: F.xxhash64(k, F.lit(0)))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), single).otherwise(let(placed, of_sorted))


def add_fingerprint(df: DataFrame, text: str, out: str, k: int = 3, bits: int = 6, l: int = 2) -> DataFrame:  # noqa: E741
    """df with the entries (bin * 65536 + tuple hash) of the text column as array<bigint>. There are 2^bits bins, which are
    the highest bits of a hash, so sorted hashes lie bin by bin."""
    unit = lambda i: F.get(F.col("_units"), i)
    kmer = lambda i: F.xxhash64(*(unit(i + j) for j in range(k)))
    kmers = F.when(F.size("_units") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_units") - k, F.lit(0))), kmer)).otherwise(F.array().cast("array<bigint>"))
    bin_of = lambda h: F.shiftright(h, 64 - bits) + (1 << bits - 1)
    df = df.withColumn("_units", F.transform(units(F.col(text)), lambda w: F.xxhash64(w))).withColumn("_kmers", kmers)
    df = df.withColumn("_hashes", _numbered(F.col("_kmers"))).withColumn("_sorted", F.sort_array("_hashes"))
    least = F.filter("_sorted", lambda h, i: ~F.coalesce(bin_of(F.get(F.col("_sorted"), i - l)) == bin_of(h), F.lit(False)))
    df = df.withColumn("_least", F.array_intersect(F.col("_hashes"), least))  # the l least of each bin, in text order
    df = df.withColumn("_dealt", F.sort_array(F.transform("_least", lambda h, i: bin_of(h) * 65536 + i)))  # bin by bin, in text order
    same_bin = lambda x, i: F.coalesce(F.shiftright(F.get(F.col("_dealt"), i), 16) == F.shiftright(x, 16), F.lit(False))
    hash_at = lambda i: F.get(F.col("_least"), F.get(F.col("_dealt"), i).bitwiseAND(65535).cast("int"))

    def entry(x: Column, i: Column) -> Column:
        """At the first k-mer of a bin: the bin and the hash of its l k-mers in text order."""
        own = F.array(hash_at(i), *(F.when(same_bin(x, i + j), hash_at(i + j)) for j in range(1, l)))
        return F.when(~same_bin(x, i - 1), F.shiftright(x, 16) * 65536 + F.pmod(F.xxhash64(own), F.lit(65536)))

    df = df.withColumn(out, F.filter(F.transform("_dealt", entry), lambda e: e.isNotNull()))
    return df.drop("_units", "_kmers", "_hashes", "_sorted", "_least", "_dealt")


def likeness(a: str, b: str) -> Column:
    bins = lambda c: F.transform(c, lambda e: F.shiftright(e, 16))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(entries: str) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", most: int = 20_000) -> DataFrame:
    """docs and `following`, a struct of the given columns of the next row by key, then by text. Rows are dealt to ranges of
    the key; a key with so many rows that it would be a range of its own is cut into `sub` ranges of text hashes. The first
    row of each range is also sent to the range before, so no range needs to see more than its own rows."""
    n = min(4 * partitions(docs.sparkSession), most)  # several ranges a partition, to even out their hashing
    sub = partitions(docs.sparkSession)
    lowest = -(1 << 63)
    placed = docs.withColumns({"_place": F.coalesce(F.col(key), F.lit(lowest)).cast("long"), "_hash": F.xxhash64("text")})
    found = [int(c) for c in placed.approxQuantile("_place", [i / n for i in range(1, n)], 1 / (2 * n))] if n > 1 else []
    crowded = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    cuts = sorted({*found, *crowded, *(c + 1 for c in crowded)})
    long_array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<bigint>")
    within = F.when(F.array_contains(long_array(crowded), F.col("_place")), F.floor((F.shiftrightunsigned(F.col("_hash").bitwiseXOR(F.lit(lowest).cast("long")), 32) * sub) / float(1 << 32))).otherwise(F.lit(0))
    ranged = placed.withColumn("_range", (bisect(long_array(cuts), lambda c: c <= F.col("_place")) + 1).cast("long") * sub + within.cast("long"))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct("_place", "_hash")).alias("first")).orderBy("_range").collect()  # a row a range
    ranges = [r["_range"] for r in firsts]
    at = bisect(long_array(ranges), lambda r: r <= F.col("_range"))
    is_first = (F.get(long_array([r["first"]["_place"] for r in firsts]), at) == F.col("_place")) & (F.get(long_array([r["first"]["_hash"] for r in firsts]), at) == F.col("_hash"))
    sent = F.when(is_first, F.get(long_array(ranges[-1:] + ranges[:-1]), at))  # the range before the first is the last
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"), F.lit(False).alias("wrapped"))
    guest = F.struct(sent.alias("range"), F.lit(True).alias("guest"), (F.col("_range") == (ranges[0] if ranges else 0)).alias("wrapped"))
    dealt = ranged.withColumn("_to", F.explode(F.filter(F.array(own, guest), lambda t: t["range"].isNotNull())))
    order = W.partitionBy("_to.range").orderBy("_to.wrapped", "_to.guest", "_place", "_hash", "text")
    dealt = dealt.withColumn("following", F.lead(F.struct(*columns)).over(order))
    return dealt.filter(~F.col("_to.guest")).drop("_place", "_hash", "_range", "_to")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = add_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "entries")
    pairs = with_next(own, ["text", "entries"]).withColumn("changed", edited(F.col("text"), F.col("following.text")))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "changed", "entries", F.col("following.entries").alias("next_entries"))
    both = add_fingerprint(pairs, "changed", "changed_entries")
    return both.select(
        "doc_id", "n_chars", F.sha2("changed", 256).alias("edited_sha256"), as_text("entries").alias("fingerprint"), as_text("changed_entries").alias("edited_fingerprint"),
        likeness("entries", "changed_entries").alias("near_edited"), likeness("entries", "next_entries").alias("near_next"),
    )
