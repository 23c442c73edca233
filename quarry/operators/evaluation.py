"""Retrieval evaluation over tables: cases (case_id, category, expected) and ranked (mode, case_id, rank, chunk_id,
document_id), all cases and modes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import decamel, slug

CASE_SCHEMA = "id string, query string, category string, expected_documents array<string>, expected_chunks array<string>"


def write_cases(cases: DataFrame, path: str) -> None:
    """A file of JSON lines a task; a null category and other nulls are left out."""
    cases.select("id", "query", "category", "expected_documents", "expected_chunks").write.mode("overwrite").json(path)


def read_cases(spark, path: str, lines: bool = False) -> DataFrame:
    """Cases of one JSON list, or of JSON lines; unknown keys are ignored, a case without id or query or a repeated id is
    refused."""
    cases = spark.read.schema(CASE_SCHEMA).option("multiLine", not lines).json(path)
    wrong = F.col("id").isNull() | (F.trim("id") == "") | F.col("query").isNull() | (F.trim("query") == "")
    once = F.count("*").over(W.partitionBy("id")) == 1
    refuse = lambda said: F.raise_error(F.lit(said))
    cases = cases.withColumn("id", F.when(wrong, refuse("a case lacks its id or query")).when(~once, refuse("case ids repeat")).otherwise(F.col("id")))
    empty = F.array().cast("array<string>")
    return cases.withColumns({c: F.coalesce(c, empty) for c in ("expected_documents", "expected_chunks")})


def document_ranking(ranked: DataFrame) -> DataFrame:
    """mode, case_id, document_id, doc_rank: documents by their best chunk."""
    best = ranked.groupBy("mode", "case_id", "document_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("doc_rank", F.row_number().over(W.partitionBy("mode", "case_id").orderBy("rank"))).drop("rank")


def per_case(cases: DataFrame, ranked: DataFrame, modes: list[str], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """mode, case_id, category, has_expectation, first_rank and found_<k>, the share of expected documents in the first k."""
    hit = document_ranking(ranked).join(cases.select("case_id", F.explode("expected").alias("document_id")), ["case_id", "document_id"])
    hit = hit.groupBy("mode", "case_id").agg(F.min("doc_rank").alias("first_rank"), *(F.count_if(F.col("doc_rank") <= k).alias(f"n_{k}") for k in ks))
    every = cases.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    label = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("uncategorized"))
    size = F.size("expected")
    return every.join(hit, ["mode", "case_id"], "left").select(
        "mode", "case_id", label.alias("category"), (size > 0).alias("has_expectation"), "first_rank", *(F.when(size > 0, F.coalesce(f"n_{k}", F.lit(0)) / size).alias(f"found_{k}") for k in ks)
    )


def metrics(judged: DataFrame, *by: str, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Recall and MRR over cases with expectations; cases counts all. The mean of nothing is 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    reciprocal = F.when(F.col("has_expectation"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))
    return judged.groupBy(*by).agg(F.count("*").alias("cases"), *(mean(f"found_{k}").alias(f"recall_{k}") for k in ks), mean(reciprocal).alias("mrr"))


def by_category(judged: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """metrics for each mode and category and, with category `overall`, each mode: one rollup."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    reciprocal = F.when(F.col("has_expectation"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))
    out = judged.rollup("mode", "category").agg(F.grouping("category").alias("whole"), F.grouping("mode").alias("all"), F.count("*").alias("cases"), *(mean(f"found_{k}").alias(f"recall_{k}") for k in ks), mean(reciprocal).alias("mrr"))
    return out.filter("all = 0").withColumn("category", F.when(F.col("whole") == 1, "overall").otherwise(F.col("category"))).drop("whole", "all")


def deltas(overall: DataFrame, base: str) -> DataFrame:
    """mode and each metric less that of the base mode."""
    names = [c for c in overall.columns if c not in ("mode", "cases")]
    ref = overall.filter(F.col("mode") == base).select(*(F.col(c).alias(f"base_{c}") for c in names))
    return overall.join(F.broadcast(ref), how="cross").select("mode", *((F.col(c) - F.col(f"base_{c}")).alias(f"delta_{c}") for c in names))


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, chunk_id, rank after, and how the chunk moved: new, same, up n, down n."""
    old = before.select("case_id", "chunk_id", F.col("rank").alias("old_rank"))
    up = F.col("old_rank") - F.col("rank")
    said = F.when(F.col("old_rank").isNull(), "new").when(up > 0, F.concat(F.lit("up "), up)).when(up < 0, F.concat(F.lit("down "), -up)).otherwise("same")
    return after.join(old, ["case_id", "chunk_id"], "left").select("case_id", "chunk_id", "rank", said.alias("move"))


def status(first_rank: Column, k: int) -> Column:
    return F.when(first_rank.isNull(), "none").when(first_rank > k, "outside").otherwise("pass")


def highlights(judged: DataFrame, k: int = 5) -> DataFrame:
    """Per mode: failed cases, those found past k, those not found."""
    said = status(F.col("first_rank"), k)
    return judged.filter("has_expectation").groupBy("mode").agg(F.count_if(said != "pass").alias("failed"), F.count_if(said == "outside").alias("outside"), F.count_if(said == "none").alias("not_found"))


# Generating cases from the corpus


# Titles that are no topic.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def corpus_documents(chunks: DataFrame) -> DataFrame:
    """document_id, title and chunk ids in order."""
    item = F.struct("chunk_index", "chunk_id")
    out = chunks.groupBy("document_id").agg(F.min("document_title").alias("title"), F.sort_array(F.collect_list(item)).alias("c"))
    return out.select("document_id", "title", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))


def value_index(rows: DataFrame, fields: tuple[str, ...], most: int = 8) -> DataFrame:
    """rows: document_id, name, kind, text, items. field, value and sorted documents, where at most `most` carry it. Counted
    first, so that the documents of a common value are never gathered."""
    one = F.when(F.col("kind") == "list", F.col("items")).when(F.col("kind") == "string", F.array("text"))
    found = rows.filter(F.col("name").isin(*fields)).select("document_id", F.col("name").alias("field"), F.explode(one).alias("value")).filter("trim(value) <> ''").distinct()
    rare = found.groupBy("field", "value").agg(F.count("*").alias("n")).filter(F.col("n") <= most).drop("n")
    return found.join(rare, ["field", "value"]).groupBy("field", "value").agg(F.sort_array(F.collect_list("document_id")).alias("documents"))


def unique_titles(docs: DataFrame) -> DataFrame:
    """Documents whose title no other has (case aside), of six characters or more and no weekday; richest first."""
    key = F.lower(F.trim("title"))
    counted = docs.withColumn("n", F.count("*").over(W.partitionBy(key)))
    good = counted.filter((F.col("n") == 1) & (F.length(F.trim("title")) >= 6) & ~key.isin(*WEEKDAYS)).drop("n")
    return good.orderBy(F.desc(F.size("chunk_ids")), F.lower("title"))


def generate_cases(index: DataFrame, docs: DataFrame) -> DataFrame:
    """id, query, category, expected_documents, expected_chunks: eight metadata, six keyword, six semantic and four hybrid
    cases at most."""
    pairs = index.orderBy("field", "value").limit(8)
    one = W.partitionBy(F.lit(0)).orderBy("field", "value")  # at most eight rows
    pairs = pairs.withColumn("nth", F.row_number().over(one)).withColumn("label", decamel(F.col("field")))
    wanted = pairs.select("nth", F.posexplode("documents").alias("pos", "document_id")).join(docs.select("document_id", "chunk_ids"), "document_id")
    chunks = wanted.groupBy("nth").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_ids"))), lambda x: x["chunk_ids"])).alias("chunks"))
    pairs = pairs.join(chunks, "nth", "left")
    tail = F.concat(slug(F.col("field")), F.lit("-"), slug(F.col("value")))
    made = lambda df, category, case_id, text, documents, chunks: df.select(case_id.alias("id"), text.alias("query"), F.lit(category).alias("category"), documents.alias("expected_documents"), chunks.alias("expected_chunks"))
    spoken = lambda before: F.concat(F.lit(before), "label", F.lit(": "), "value")
    titled = unique_titles(docs).limit(6)
    cut = lambda kind: F.left(F.concat(F.lit(f"{kind}-"), slug(F.col("title"))), F.lit(60))
    own, ids = F.array("document_id"), F.col("chunk_ids")
    return (
        made(pairs, "metadata", F.concat(F.lit("metadata-"), tail), spoken(""), F.col("documents"), F.col("chunks"))
        .unionByName(made(titled, "keyword", cut("keyword"), F.trim("title"), own, ids))
        .unionByName(made(titled, "semantic", cut("semantic"), F.concat(F.lit("What do my notes say about "), F.trim("title"), F.lit("?")), own, ids))
        .unionByName(made(pairs.filter("nth <= 4"), "hybrid", F.concat(F.lit("hybrid-"), tail), spoken("what did I work on "), F.col("documents"), F.col("chunks")))
    )


# Reports


def table_text(df: DataFrame, markdown: bool = False, most: int = 200) -> str:
    """The first rows as an aligned text table or a markdown one."""
    rows = [[c for c in df.columns], *([f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.limit(most).collect())]
    if markdown:
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]])
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows)


def performance_table(judged: DataFrame, timings: DataFrame, markdown: bool = False, k: int = 5) -> str:
    """One row a mode: recall at k, MRR and mean latency. timings: mode, stage, ms (one row a run and stage, `total` too)."""
    whole = metrics(judged, "mode", ks=(k,)).select("mode", f"recall_{k}", "mrr")
    total = timings.filter("stage = 'total'").groupBy("mode").agg(F.avg("ms").alias("avg_latency_ms"))
    out = whole.join(total, "mode", "left").orderBy("mode")
    return table_text(out, markdown) if not judged.isEmpty() else "(no runs)"


def latency_table(timings: DataFrame, markdown: bool = False) -> str:
    """Mean milliseconds of each stage (columns, in the order of the pipeline) for each mode; - where a mode lacks one."""
    if timings.isEmpty():
        return "(no runs)"
    known = {r["stage"] for r in timings.select("stage").distinct().collect()}  # a handful of stage names
    stages = [s for s in STAGES if s in known] + sorted(known - set(STAGES))
    out = timings.groupBy("mode").pivot("stage", stages).agg(F.round(F.avg("ms"), 1)).orderBy("mode")
    return table_text(out.select("mode", *(F.coalesce(F.col(s).cast("string"), F.lit("-")).alias(s) for s in stages)), markdown)


STAGES = ("analysis", "vector", "bm25", "fusion", "rerank", "total")


def report(cases: DataFrame, judged: DataFrame, k: int = 5, most: int = 200, title: str = "RETRIEVAL EVALUATION REPORT") -> str:
    """Overall metrics, a block for each of the first `most` cases of each mode, and the problem cases."""
    ks = tuple(int(c.removeprefix("found_")) for c in judged.columns if c.startswith("found_"))
    overall = metrics(judged, "mode", ks=ks).orderBy("mode").collect()
    said = status(F.col("first_rank"), k)
    shown = judged.join(cases.select("case_id", "query", "expected"), "case_id").withColumn("status", said).orderBy("mode", "case_id").limit(most).collect()
    line, thin = "=" * 72, "-" * 72
    out = [line, title, line]
    for r in overall:
        out += [f"{r['mode']}: {r['cases']} queries", *(f"  {c:<12} {r[c]:.4f}" for c in (*(f"recall_{n}" for n in ks), "mrr")), thin]
    for r in shown:
        passed = "PASS" if r["status"] == "pass" else "FAIL"
        rank = "none" if r["first_rank"] is None else r["first_rank"]
        out += [f"[{passed}] {r['mode']} {r['case_id']} ({r['category']})", f"  query: {r['query']}", f"  expected: {r['expected']}", f"  first relevant rank: {rank}", ""]
    for r in highlights(judged, k).orderBy("mode").collect():
        out.append(f"{r['mode']}: {r['failed']} failed, {r['outside']} past the first {k}, {r['not_found']} not found")
    return "\n".join([*out, line])


def generation_report(answers: DataFrame, context: DataFrame, most: int = 200) -> str:
    """Markdown of the first `most` queries: answer, sources, citations and how long the answer took. answers: query_id,
    text, answer, generation_ms; context: query_id, reference_id, title, content."""
    from quarry.functions.text import report_snippet
    from quarry.operators.context import reference_ids

    sources = context.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("reference_id", "title", report_snippet(F.col("content")).alias("snippet")))).alias("sources"))
    rows = answers.withColumn("said", F.array_distinct(reference_ids(F.col("answer")))).join(sources, "query_id", "left").orderBy("query_id").limit(most).collect()
    out = []
    for r in rows:
        known = [s["reference_id"] for s in r["sources"] or []]
        good, bad = [i for i in r["said"] if i in known], [i for i in r["said"] if i not in known]
        out += [f"## {r['text']}", "", r["answer"], "", f"- generation: {r['generation_ms']:.0f} ms", f"- citations: {good}", f"- dropped: {bad}", ""]
        out += [f"{s['reference_id']}. **{s['title']}**: {s['snippet']}" for s in r["sources"] or []] + [""]
    return "\n".join(out)
