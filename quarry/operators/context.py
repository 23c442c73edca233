"""From ranked chunks to a prompt, and from an answer to citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize, report_snippet, token_estimate
from quarry.storage import written

BUDGET = 2000
NUL = "\x00"


def build_context(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, reference_id, rank, chunk_id, content, tokens (and title and properties, if ranked has them) of the chunks
    that fit: in rank order, without those whose normalized text holds or is held by a kept one, up to the first that would
    pass the budget; the first always fits. ranked holds the few best of each query; it is computed once."""
    ranked = written(ranked, "ranked")
    more = [c for c in ("title", "properties") if c in ranked.columns]
    size = F.struct("rank", "chunk_id", normalize(F.col("content")).alias("norm"), token_estimate(F.col("content")).alias("tokens"))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(size)).alias("items"))
    kind = lists.schema["items"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        again = F.exists(acc["kept"], lambda k: F.contains(k["norm"], x["norm"]) | F.contains(x["norm"], k["norm"]))
        over = (F.size(acc["kept"]) > 0) & (acc["used"] + x["tokens"] > budget)
        return F.when(acc["full"] | again, acc).when(over, F.struct(acc["used"].alias("used"), F.lit(True).alias("full"), acc["kept"].alias("kept"))).otherwise(
            F.struct((acc["used"] + x["tokens"]).alias("used"), F.lit(False).alias("full"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        )

    kept = lists.select("query_id", F.posexplode(F.aggregate("items", start, step, lambda acc: acc["kept"])).alias("i", "x"))
    kept = kept.select("query_id", (F.col("i") + 1).alias("reference_id"), "x.rank", "x.chunk_id", "x.tokens")
    return kept.join(ranked.select("query_id", "rank", "chunk_id", "content", *more), ["query_id", "rank", "chunk_id"]).select("query_id", "reference_id", "rank", "chunk_id", "content", "tokens", *more)


def reference_ids(answer: Column) -> Column:
    """Numbers in brackets, in order, repeats included: [1], [2][3], [1, 2], [3;4]."""
    # Fixed value: how citations look.
    groups = F.regexp_extract_all(answer, F.lit(r"\[([0-9]+(?:\s*[,;]\s*[0-9]+)*)\]"), 1)
    return F.flatten(F.transform(groups, lambda g: F.transform(F.regexp_extract_all(g, F.lit("[0-9]+"), 0), lambda n: n.try_cast("int"))))


def citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, pos, reference_id, chunk_id: known references by first appearance."""
    said = answers.select("query_id", F.posexplode(F.array_distinct(reference_ids(F.col("answer")))).alias("pos", "reference_id"))
    return said.join(context.select("query_id", "reference_id", "chunk_id"), ["query_id", "reference_id"])


def dropped(answers: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, reference_id of references that no source has."""
    said = answers.select("query_id", F.explode(F.array_distinct(reference_ids(F.col("answer")))).alias("reference_id"))
    return said.join(context, ["query_id", "reference_id"], "left_anti")


def property_lines(properties: Column) -> Column:
    """`Properties:` and a line for each, lists joined by commas; empty if there are none."""
    said = lambda v: F.when(v["kind"] == "list", F.array_join(v["items"], ", ")).otherwise(v["text"])
    lines = F.transform(F.map_entries(properties), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(said(e["value"]), F.lit(""))))
    return F.when(F.size(properties) > 0, F.concat(F.lit("Properties:\n"), F.array_join(lines, "\n")))


@dataclass(frozen=True)
class Template:
    """What a model is told. The wording is this library's own; the parts and their order are what callers rely on."""

    system: str = "Answer from the numbered sources alone. Cite each statement with the number of its source in brackets. If the sources do not answer the question, say so."
    before: str = "Sources:\n\n"
    none: str = "(no sources found)"
    between: str = "\n\nQuestion: "
    after: str = ""


TEMPLATES = {"grounded": Template()}


def template(name: str = "grounded") -> Template:
    try:
        return TEMPLATES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown prompt template {name!r}; there are: {', '.join(sorted(TEMPLATES))}") from None


def prompts(queries: DataFrame, context: DataFrame, form: Template | str = "grounded") -> DataFrame:
    """query_id, system, user: numbered sources (title, properties and content, each if there), then the question. An empty
    question is refused."""
    form = template(form) if isinstance(form, str) else form
    head = F.concat(F.lit("["), F.col("reference_id").cast("string"), F.lit("]"))
    parts = [F.concat_ws(" ", head, F.col("title")) if "title" in context.columns else head, *([property_lines(F.col("properties"))] if "properties" in context.columns else []), F.col("content")]
    source = F.concat_ws("\n", *parts)
    sources = context.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reference_id", source.alias("s")))), lambda x: x["s"]), "\n\n").alias("sources"))
    asked = queries.join(sources, "query_id", "left").withColumn("text", F.when(F.trim("text") != "", F.trim("text")).otherwise(F.raise_error(F.lit("the question is empty"))))
    user = F.concat(F.lit(form.before), F.coalesce("sources", F.lit(form.none)), F.lit(form.between), F.col("text"), F.lit(form.after))
    return asked.select("query_id", F.lit(form.system).alias("system"), user.alias("user"))


def citation_json(cited: Column) -> Column:
    """Citations (array of structs) as JSON, for the last frame of an answer."""
    return F.coalesce(F.to_json(cited), F.lit("[]"))


def mock_answer(user: Column, canned: tuple[str, ...] = (), call: Column | None = None) -> Column:
    """Canned answers in turn, else one that cites the first source if there is any."""
    if canned:
        return F.get(F.array(*map(F.lit, canned)), (call % len(canned)).cast("int"))
    return F.when(F.contains(user, F.lit("[1]")), "The sources say so [1].").otherwise("The sources do not answer this question.")


def frames(sources: Column, answer: Column, cited: Column, millis: Column) -> Column:
    """What is sent for an answer: sources as a line of JSON, the text, NUL and a last frame of JSON."""
    end = F.to_json(F.struct(cited.alias("citations"), millis.alias("generation_ms")))
    return F.concat(F.to_json(F.struct(sources.alias("sources"))), F.lit("\n"), answer, F.lit(NUL), end)


def grounding(answer: Column, sources: Column, stopwords: tuple[str, ...]) -> tuple[Column, Column]:
    """Share of an answer's words (four letters and more, no stopwords) that the sources have, and how many they lack."""
    terms = lambda t: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9][a-z0-9_-]*"), 0)), lambda w: (F.length(w) >= 4) & ~w.isin(*stopwords))
    a, s = terms(answer), terms(sources)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, s)) / F.size(a)), F.size(F.array_except(a, s))


__all__ = ["TEMPLATES", "Template", "build_context", "citation_json", "citations", "dropped", "frames", "grounding", "mock_answer", "prompts", "property_lines", "reference_ids", "report_snippet", "template"]
