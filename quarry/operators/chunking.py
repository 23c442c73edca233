"""Structure-aware chunking: small documents whole, else by sections, then paragraphs, sentences, words. All in built-in
functions on the row; documents never meet, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import SPACE, let, sentences, strip, words

MAX_WORDS = 250
# Fixed value: what a heading line looks like.
HEADING = rf"(?s)^#{{1,3}}{SPACE}+.+\z"


def n_words(text: Column) -> Column:
    return F.size(words(text))


def sections(content: Column) -> Column:
    """array<struct<title, body>>: headings of one to three marks begin a section; sections without a body vanish; if none
    is left, the whole content is one without a title."""

    def of(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(HEADING)), i)), lambda i: i.isNotNull())
        return let(F.concat(F.array(F.lit(-1)), heads), lambda cuts: F.filter(F.transform(cuts, lambda at, i: one(lines, cuts, at, i)), lambda s: s["body"] != ""))

    def one(lines: Column, cuts: Column, at: Column, i: Column) -> Column:
        end = F.coalesce(F.get(cuts, i + 1), F.size(lines))
        title = F.when(at >= 0, strip(F.regexp_replace(F.get(lines, at), rf"^#+{SPACE}+", "")))
        return F.struct(title.alias("title"), strip(F.array_join(F.slice(lines, at + 2, end - at - 1), "\n")).alias("body"))

    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), content.alias("body")))
    return let(let(F.split(content, "\n", -1), of), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def _packed(parts: Column, joint: str, split) -> Column:  # noqa: ANN001
    """Greedy packing of parts into groups of at most MAX_WORDS words; a longer part is split on its own. Words are counted
    once a part; a fold over the counts finds where groups begin, and each group is joined once."""

    def cuts(counts: Column) -> Column:
        """Where groups begin, and the end. A part begins one if it, the part before or both together are too long."""

        def step(acc: Column, n: Column) -> Column:
            begins = (n > MAX_WORDS) | (acc["run"] + n > MAX_WORDS)
            return F.struct(
                F.when(begins, n).otherwise(acc["run"] + n).alias("run"), (acc["at"] + 1).alias("at"), F.when(begins, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts")
            )

        start = F.struct(F.lit(MAX_WORDS + 1).alias("run"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))
        return F.aggregate(counts, start, step, lambda acc: F.concat(acc["cuts"], F.array(acc["at"])))

    def joined(ps: Column, counts: Column, at: Column) -> Column:
        def group(begin: Column, i: Column) -> Column:
            whole = lambda: F.array_join(F.slice(ps, begin + 1, F.get(at, i + 1) - begin), joint)
            return F.when(F.get(counts, begin) > MAX_WORDS, split(F.get(ps, begin))).otherwise(F.array(whole()))

        return F.flatten(F.transform(F.slice(at, 1, F.size(at) - 1), group))

    return let(parts, lambda ps: let(F.transform(ps, n_words), lambda counts: let(cuts(counts), lambda at: joined(ps, counts, at))))


def by_words(text: Column) -> Column:
    """Slices of MAX_WORDS words."""
    return let(words(text), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(MAX_WORDS)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(MAX_WORDS)), " ")))


def by_sentences(paragraph: Column) -> Column:
    said = F.filter(F.transform(sentences(paragraph), strip), lambda s: s != "")
    return _packed(said, " ", by_words)


def by_paragraphs(content: Column) -> Column:
    parts = F.filter(F.transform(F.split(content, "\n\n", -1), strip), lambda p: p != "")
    return _packed(parts, "\n\n", by_sentences)


def chunk_text(title: Column, section: Column, body: Column) -> Column:
    """Title and section head the chunk's content."""
    return F.concat_ws("\n\n", F.concat(F.lit("**"), title, F.lit("**")), F.when(section != "", F.concat(F.lit("### "), section)), body)


def bodies(content: Column) -> Column:
    """array<struct<title, body>> of a document's chunks in order."""
    one = lambda title, body: F.struct(title.cast("string").alias("title"), body.alias("body"))
    of_section = lambda s: F.when(n_words(s["body"]) <= MAX_WORDS, F.array(one(s["title"], s["body"]))).otherwise(F.transform(by_paragraphs(s["body"]), lambda b: one(s["title"], b)))
    return F.when(n_words(content) <= MAX_WORDS, F.array(one(F.lit(None), content))).otherwise(F.flatten(F.transform(sections(content), of_section)))


def chunk_documents(documents: DataFrame) -> DataFrame:
    """documents: id, title, content and others, which are kept. Adds document_id, document_title, chunk_index, chunk_id,
    section_title and replaces content by the chunk's."""
    out = documents.withColumn("content", F.coalesce("content", F.lit("")))
    # an inner explode would have the optimizer evaluate its argument twice more, for a filter on its size
    out = out.select("*", F.posexplode_outer(bodies(F.col("content"))).alias("chunk_index", "chunk")).filter("chunk_index IS NOT NULL")
    kept = [c for c in documents.columns if c not in ("id", "title", "content")]
    return out.select(
        F.concat_ws("_", "id", "chunk_index").alias("chunk_id"), F.col("id").alias("document_id"), F.col("title").alias("document_title"), "chunk_index",
        F.nullif(F.col("chunk.title"), F.lit("")).alias("section_title"), chunk_text(F.col("title"), F.col("chunk.title"), F.col("chunk.body")).alias("content"), F.col("chunk.body").alias("body"), *kept,
    )
