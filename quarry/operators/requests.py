"""Query understanding over whole tables of queries: field syntax, model intents and how the two are merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.dates import normalize_date_token, temporal_bounds
from quarry.functions.text import clean_value, collapse, let, strip, surface_key
from quarry.operators.schema import validate_filters

HEAD, MID = "\x01", "\x02"
DATE_TOKEN = r"\b[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}\b"
INTENT = "struct<semantic_query: string, filters: array<struct<field: string, operator: string, value: string>>, temporal: struct<kind: string, unit: string, anchor: string>>"


@dataclass(frozen=True)
class Field:
    canonical: str
    surfaces: tuple[str, ...]
    kind: str = "text"
    multi: bool = False


# The fields that are known without an index.
DEFAULT_FIELDS = (
    Field("leetcode", ("leetcode",)),
    Field("leetcodeTopic", ("leetcode topic", "leetcodetopic")),
    Field("personalWin", ("personal win", "personalwin")),
    Field("workWin", ("work win", "workwin")),
    Field("category", ("category",)),
    Field("date", ("date",), kind="date"),
    Field("status", ("status",)),
    Field("project", ("project",)),
    Field("team", ("team",)),
    Field("tags", ("tags", "tag"), multi=True),
)


def _quoted(surface: str) -> str:
    return r"\s+".join(rf"\Q{w}\E" for w in surface.split())


def parse_queries(queries: DataFrame, fields: tuple[Field, ...] = DEFAULT_FIELDS, text: str = "text", keep_lost: bool = False) -> DataFrame:
    """Adds semantic_query and filters (array<struct<field, operator, value>>). `field: value`, `field = value` and `field
    is value` are filters; a value reaches to the next field. Of a date field only the date is taken. A field without a
    usable value loses its span, unless keep_lost."""
    surfaces = sorted({s for f in fields for s in f.surfaces}, key=lambda s: (-len(s), s))
    if not surfaces:
        return queries.withColumns({"semantic_query": strip(F.col(text)), "filters": F.array().cast("array<struct<field:string,operator:string,value:string>>")})
    head = rf"(?i)\b({'|'.join(map(_quoted, surfaces))})\b\s*(?::|=|\bis\b)\s*"
    by_key = {"".join(c for c in s.lower() if c.isalnum()): f for f in fields for s in f.surfaces}
    named = lambda value: F.create_map(*(x for k, f in by_key.items() for x in (F.lit(k), F.lit(value(f)))))
    canonical, kind, multi = named(lambda f: f.canonical), named(lambda f: f.kind), named(lambda f: f.multi)

    def of(part: Column) -> Column:
        key = surface_key(F.substring_index(part, MID, 1))
        span = F.substring_index(part, MID, -1)
        token = F.regexp_extract(span, DATE_TOKEN, 0)
        dated = F.element_at(kind, key) == "date"
        value = F.when(dated, F.coalesce(normalize_date_token(token), F.lit(""))).otherwise(clean_value(span))
        before = F.position(token, span) - 1
        rest = F.when(dated & (token != ""), strip(F.concat_ws(" ", F.left(span, before), F.substr(span, before + F.length(token) + 1))))
        if keep_lost:
            rest = F.coalesce(rest, F.when(value == "", span))
        return F.struct(
            F.element_at(canonical, key).alias("field"), F.when(F.element_at(multi, key), "contains").otherwise("equals").alias("operator"), value.alias("value"), rest.alias("rest"),
        )

    marked = F.split(F.regexp_replace(F.translate(text, HEAD + MID, "  "), head, f"{HEAD}$1{MID}"), HEAD, -1)
    out = queries.withColumn("_parts", marked).withColumn("_found", F.transform(F.slice("_parts", F.lit(2), F.size("_parts")), of))
    semantic = collapse(F.concat_ws(" ", F.get("_parts", F.lit(0)), F.array_join(F.col("_found.rest"), " ")))
    filters = F.transform(F.filter("_found", lambda x: x["value"] != ""), lambda x: F.struct(x["field"].alias("field"), x["operator"].alias("operator"), x["value"].alias("value")))
    return out.withColumns({"semantic_query": semantic, "filters": filters}).drop("_parts", "_found")


def merge_filters(filters: DataFrame) -> DataFrame:
    """filters: query_id, source (0 rule, 1 model), pos, field, ... Rule filters stay; of the model's the first of each
    field that no rule filter has."""
    by_field = W.partitionBy("query_id", "field")
    n = F.row_number().over(by_field.orderBy("source", "pos"))
    return filters.withColumns({"_n": n, "_rule": F.min("source").over(by_field)}).filter((F.col("source") == 0) | ((F.col("_rule") == 1) & (F.col("_n") == 1))).drop("_n", "_rule")


def merge_semantic(has_rule_filters: Column, rule: Column, model: Column) -> Column:
    """The rule's text where it found filters, else the model's; the other one if that is empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(has_rule_filters, some(rule)).otherwise(some(model)), F.when(has_rule_filters, some(model)).otherwise(some(rule)), F.lit(""))


def parse_intent(answer: Column, question: Column) -> Column:
    """The JSON object between the first and the last brace, as INTENT; without a rewrite the question itself."""
    found = F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")), INTENT)
    return let(found, lambda x: F.when(x.isNotNull(), x.withField("semantic_query", F.coalesce(F.nullif(collapse(x["semantic_query"]), F.lit("")), question))))


def fold_temporal(filters: Column, low: Column, high: Column, authored: str = "last_edited_time") -> Column:
    """With bounds, filters on the authored time and on `date` give way to one between filter. values is an array."""
    others = F.filter(filters, lambda f: ~f["field"].isin(authored, "date"))
    span = F.struct(F.lit(authored).alias("field"), F.lit("between").alias("operator"), F.array(low, high).alias("values"))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(others, F.array(span))).otherwise(filters)


def intent_prompt(question: Column, schema_json: Column, today: str) -> tuple[Column, Column]:
    """System and user text that ask a model for INTENT."""
    system = (
        "Turn the question into a search request. Reply with one JSON object and nothing else: semantic_query (the question in search terms), filters (a list of field, operator, value; only fields, "
        f"operators and types of the schema), temporal (kind single or range, unit week or month, anchor copied from the question) or null. Today is {today}."
    )
    return F.lit(system), F.concat(F.lit("Schema:\n"), schema_json, F.lit("\n\nQuestion: "), question)


def analyze(queries: DataFrame, answers: DataFrame | None, fields: tuple[Field, ...] = DEFAULT_FIELDS, schema: DataFrame | None = None, today: str | None = None, authored: str = "last_edited_time") -> DataFrame:
    """query_id, semantic_query, filters (array<struct<field, operator, values, type>>: the rule filters, then the
    model's). answers: query_id, answer of a model. The model's filters come through only as far as the schema validates
    them (all do, untyped, if none is given), its temporal part becomes a between filter on the authored time; a query
    without a usable answer keeps its rule result."""
    kind = "array<struct<field:string,operator:string,values:array<string>,type:string>>"
    ruled = parse_queries(queries, fields)
    ruled = ruled.withColumn("filters", F.transform("filters", lambda f: F.struct(f["field"].alias("field"), f["operator"].alias("operator"), F.array(f["value"]).alias("values"), F.lit("string").alias("type"))))
    if answers is None:
        return ruled.select("query_id", "semantic_query", "filters")
    both = ruled.join(answers, "query_id", "left").withColumn("intent", parse_intent(F.col("answer"), F.col("text")))
    said = both.select("query_id", "text", F.posexplode("intent.filters").alias("pos", "f")).select(
        "query_id", "text", "pos", F.col("f.field").alias("field"), F.col("f.operator").alias("operator"), _values(F.col("f.value")).alias("values"))
    if schema is not None:
        day = F.lit(today).cast("date") if today else F.current_date()
        has_year = F.rlike("text", F.lit("[0-9]{4}"))
        keyed = said.withColumn("id", F.struct("query_id", "pos")).withColumn("keep_year", has_year)
        typed = validate_filters(keyed.select("id", "field", "operator", "values", "keep_year"), schema, day)
        said = typed.join(schema.select(F.col("name").alias("field"), "type"), "field").select("id.query_id", "id.pos", "field", "operator", "values", "type")
    else:
        said = said.select("query_id", "pos", "field", "operator", "values", F.lit("string").alias("type"))
    item = F.struct("pos", F.struct("field", "operator", "values", "type").alias("f"))
    mine = said.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["f"]).cast(kind).alias("proposed"))
    both = both.join(mine, "query_id", "left").withColumn("proposed", F.coalesce("proposed", F.array().cast(kind)))
    if today:
        bounds = temporal_bounds(F.col("intent.temporal.kind"), F.col("intent.temporal.unit"), F.col("intent.temporal.anchor"), F.col("text"), F.lit(today).cast("date"))
        others = F.filter("proposed", lambda f: ~f["field"].isin(authored, "date"))
        span = F.struct(F.lit(authored).alias("field"), F.lit("between").alias("operator"), F.array("bounds.low", "bounds.high").alias("values"), F.lit("date").alias("type"))
        both = both.withColumn("bounds", bounds).withColumn("proposed", F.when(F.col("bounds").isNotNull(), F.concat(others, F.array(span))).otherwise(F.col("proposed")))
    ruled_fields = F.transform("filters", lambda f: f["field"])
    new = F.filter("proposed", lambda f: ~F.array_contains(ruled_fields, f["field"]))
    both = both.withColumn("new", new)
    names = F.transform("new", lambda f: f["field"])
    first = F.filter("new", lambda f, i: F.array_position(names, f["field"]) == i + 1)
    semantic = merge_semantic(F.size("filters") > 0, F.col("semantic_query"), F.coalesce("intent.semantic_query", F.lit("")))
    return both.select("query_id", semantic.alias("semantic_query"), F.concat("filters", first).alias("filters"))


def _values(value: Column) -> Column:
    """A JSON list of texts, or one text."""
    listed = F.from_json(F.when(F.startswith(F.trim(value), F.lit("[")), value), "array<string>")
    return F.coalesce(listed, F.array(value))
