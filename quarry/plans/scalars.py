"""Queries of the scalar functions: text (F1-F7, R4, C2, C3, W2, I16, I17) and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as X
from quarry.plans.common import TODAY, sql_collapse, sql_strip, sql_words, table

QUERIES, ORACLES = {}, {}


def on(name: str, source: str, key: str, sql: str, columns):
    """Registers a projection of one table; columns makes the select list, sql states it."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(*key.split(", "), *(c.alias(n) for n, c in columns().items()))

    QUERIES[name], ORACLES[name] = run, f"SELECT {key}, {sql} FROM {source}"


C = F.col
PART = lambda: F.concat_ws(" ", C("p_name"), F.concat(C("p_brand"), F.lit("_"), C("p_type")), F.lit("--x9"))
SQL_PART = "concat_ws(' ', p_name, p_brand || '_' || p_type, '--x9')"
on("camel_case", "part", "p_partkey", f"""array_to_string(list_transform(regexp_extract_all({SQL_PART}, '[A-Za-z0-9]+'),
   lambda p, i: CASE WHEN i = 1 THEN lower(p) ELSE upper(p[1]) || lower(p[2:]) END), '') AS camel""", lambda: dict(camel=X.camel_case(PART())))  # fmt: skip
on("decamel", "part", "p_partkey", r"lower(trim(replace(regexp_replace(replace(p_name || 'FieldX' || '_yZ1Q', ' ', 'Q'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '))) AS words",
   lambda: dict(words=X.decamel(F.concat(F.replace(C("p_name"), F.lit(" "), F.lit("Q")), F.lit("FieldX"), F.lit("_yZ1Q")))))
on("surface_key", "documents", "doc_id", r"regexp_replace(lower(left(text, 60)), '[^\p{L}\p{N}]', '', 'g') AS surface", lambda: dict(surface=X.surface_key(F.left("text", F.lit(60)))))
on("slug", "documents", "doc_id", r"lower(array_to_string(regexp_extract_all(left(text, 50), '[\p{L}\p{N}]+'), '-')) AS slug", lambda: dict(slug=X.slug(F.left("text", F.lit(50)))))
on("tokenize", "documents", "doc_id", "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INTEGER AS n_tokens",
   lambda: dict(tokens=F.array_join(X.tokenize(C("text")), " "), n_tokens=F.size(X.tokenize(C("text")))))
on("token_estimate", "documents", "doc_id", "greatest(1, length(text) // 4)::BIGINT AS tokens", lambda: dict(tokens=X.token_estimate(C("text"))))
on("normalize_text", "documents", "doc_id", f"lower({sql_collapse('text')}) AS normalized", lambda: dict(normalized=X.normalize(C("text"))))
on("report_snippet", "documents", "doc_id", f"CASE WHEN length({sql_collapse('text')}) <= 400 THEN {sql_collapse('text')} ELSE rtrim(left({sql_collapse('text')}, 400)) || '…' END AS snippet", lambda: dict(snippet=X.report_snippet(C("text"))))
on("source_snippets", "documents", "doc_id", f"left({sql_collapse('text')}, 200) AS snippet, round(n_chars / 7.0, 6)::DOUBLE AS score", lambda: dict(snippet=X.snippet(C("text")), score=F.round(C("n_chars") / 7.0, 6)))
on("point_ids", "documents", "doc_id", """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17])::INTEGER, 1) || h[18:20] || '-' || h[21:32]
   FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR || '_0')) AS h)) AS point_id""", lambda: dict(point_id=X.point_id(F.concat(C("doc_id").cast("string"), F.lit("_0")))))  # fmt: skip
# No look-behind in RE2: sentence ends are marked first, marks after abbreviations taken back.
on("split_sentences", "documents", "doc_id", r"""array_to_string(string_split(regexp_replace(regexp_replace(
   regexp_replace(regexp_replace(text, '([.!?])([ \t\n\x0b\f\r]+)([A-Z"(\[])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), '([A-Z][a-z]{1,2}\.)\x01([ \t\n\x0b\f\r]+)\x02', '\1\2', 'g'),
   '\x01[ \t\n\x0b\f\r]+\x02', chr(1), 'g'), '\x02', '', 'g'), chr(1)), '¶') AS sentences""", lambda: dict(sentences=F.array_join(X.sentences(C("text")), "¶")))  # fmt: skip
on("chunk_words", "documents", "doc_id", f"list_transform(range(0, len({sql_words('text')}), 250), lambda i: array_to_string({sql_words('text')}[i + 1:i + 250], ' ')) AS slices",
   lambda: dict(slices=F.transform(F.when(F.size(X.words(C("text"))) > 0, F.sequence(F.lit(0), F.size(X.words(C("text"))) - 1, F.lit(250))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(X.words(C("text")), i + 1, F.lit(250)), " "))))

DAY = lambda: F.col("o_orderdate").cast("date")
on("week_span", "orders", "o_orderkey", "date_trunc('week', o_orderdate)::DATE AS low, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE AS high", lambda: dict(low=D.week_span(DAY())[0], high=D.week_span(DAY())[1]))
on("month_span", "orders", "o_orderkey", "date_trunc('month', o_orderdate)::DATE AS low, last_day(o_orderdate) AS high", lambda: dict(low=D.month_span(DAY())[0], high=D.month_span(DAY())[1]))
UNIT = lambda: F.element_at(F.array(*map(F.lit, ("week", "month", "year"))), (C("o_orderkey") % 3 + 1).cast("int"))
on("snap_unit", "orders", "o_orderkey", """CASE o_orderkey % 3 WHEN 0 THEN date_trunc('week', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE END AS low,
   CASE o_orderkey % 3 WHEN 0 THEN (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE WHEN 1 THEN last_day(o_orderdate) END AS high""", lambda: dict(low=D.snap(DAY(), UNIT())[0], high=D.snap(DAY(), UNIT())[1]))  # fmt: skip
on("utc_bounds", "orders", "o_orderkey", """strftime(timezone('America/New_York', date_trunc('day', o_orderdate)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS low,
   strftime(timezone('America/New_York', date_trunc('day', o_orderdate) + INTERVAL 1 DAY) AT TIME ZONE 'UTC' - INTERVAL 1 MICROSECOND, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS high""",
   lambda: dict(low=D.rfc3339(D.utc_bounds(DAY(), DAY(), "America/New_York")[0]), high=D.rfc3339(D.utc_bounds(DAY(), DAY(), "America/New_York")[1])))
on("clamp_year", "orders", "o_orderkey", f"""(SELECT CASE WHEN c > DATE '{TODAY}' THEN make_date(2023, m, least(d, day(last_day(make_date(2023, m, 1))))) ELSE c END
   FROM (SELECT month(o_orderdate) AS m, day(o_orderdate) AS d, make_date(2024, m, least(d, day(last_day(make_date(2024, m, 1))))) AS c)) AS clamped""", lambda: dict(clamped=D.clamp_year(DAY(), F.lit(TODAY).cast("date"))))  # fmt: skip
TOKEN = lambda: F.when(C("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(C("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yy-MM-dd"))
on("normalize_dates", "orders", "o_orderkey", "CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso", lambda: dict(iso=D.normalize_date_token(TOKEN())))
TEXT_DATE = lambda: F.when(C("o_orderkey") % 4 == 0, C("o_orderdate").cast("string")).when(C("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(C("o_orderkey") % 4 == 2, C("o_orderpriority")).otherwise(F.lit("2023-02-30 x"))
on("is_iso_date", "orders", "o_orderkey", "o_orderkey % 4 = 0 AS is_date, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate::DATE END AS day", lambda: dict(is_date=D.is_iso_date(TEXT_DATE()), day=D.iso_date(TEXT_DATE())))

# Phrases, descriptions of spans and values said of each order.
KEY, N = lambda: C("o_custkey") % 8, lambda: C("o_orderkey") % 400
SAID_WORDS = ("Today", "day before  yesterday", "last week", "this month", "sometime")


def chosen(key, *options):
    """The option with the number that key has."""
    return F.element_at(F.array(*(o.cast("string") for o in options)), (key + 1).cast("int"))


on("resolve_phrases", "orders", "o_orderkey", f"""CASE o_custkey % 8 WHEN 0 THEN DATE '{TODAY}' - (o_orderkey % 400)::INTEGER WHEN 1 THEN DATE '{TODAY}' - 7 * (o_orderkey % 400)::INTEGER WHEN 2 THEN (DATE '{TODAY}' - to_months((o_orderkey % 400)::INTEGER))::DATE
   WHEN 3 THEN (SELECT CASE WHEN c > DATE '{TODAY}' THEN make_date(2023, m, least(d, day(last_day(make_date(2023, m, 1))))) ELSE c END FROM (SELECT month(o_orderdate) AS m, day(o_orderdate) AS d, make_date(2024, m, d) AS c))
   WHEN 4 THEN o_orderdate::DATE WHEN 5 THEN o_orderdate::DATE
   WHEN 7 THEN [DATE '{TODAY}', DATE '{TODAY}' - 2, DATE '{TODAY}' - 7, DATE '{TODAY}', NULL][o_orderkey % 5 + 1] END AS day""",
   lambda: dict(day=D.resolve_phrase(chosen(KEY(), F.concat(N().cast("string"), F.lit(" days ago")), F.concat(N().cast("string"), F.lit("  Week ago")), F.concat(N().cast("string"), F.lit(" months ago")), F.date_format("o_orderdate", "MMMM d"),
       F.date_format("o_orderdate", "MMMM d, yyyy"), F.date_format("o_orderdate", " yyyy-MM-dd"), C("o_orderpriority"), chosen(C("o_orderkey") % 5, *map(F.lit, SAID_WORDS))), F.lit(TODAY).cast("date"))))


def spans():
    """Bounds of `N days ago` as a day or as the week or month around it; no anchor in the query, no bounds."""
    anchor, kind = F.concat(N().cast("string"), F.lit(" days ago")), chosen(C("o_custkey") % 3, F.lit("single"), F.lit(" Range"), F.lit(""))
    query = F.when(C("o_custkey") % 5 == 4, F.lit("no date here")).otherwise(F.concat(F.lit("What did I do "), N().cast("string"), F.lit("  Days ago?")))
    found = D.temporal_bounds(kind, chosen(C("o_orderkey") % 4, *map(F.lit, ("week", "month", "year", ""))), anchor, query, F.lit(TODAY).cast("date"))
    return dict(low=found["low"], high=found["high"])


SQL_SPAN = f"""(SELECT {{}} FROM (SELECT CASE WHEN o_custkey % 3 = 1 THEN CASE o_orderkey % 4 WHEN 0 THEN date_trunc('week', d) WHEN 1 THEN date_trunc('month', d) END ELSE d END::DATE AS a,
   CASE WHEN o_custkey % 3 = 1 THEN CASE o_orderkey % 4 WHEN 0 THEN date_trunc('week', d) + INTERVAL 6 DAY WHEN 1 THEN last_day(d) END ELSE d END::DATE AS b
   FROM (SELECT CASE WHEN o_custkey % 5 <> 4 THEN DATE '{TODAY}' - (o_orderkey % 400)::INTEGER END AS d)))"""
on("temporal_bounds", "orders", "o_orderkey", SQL_SPAN.format("strftime(a::TIMESTAMP, '%Y-%m-%dT%H:%M:%S+00:00')") + " AS low, " + SQL_SPAN.format("strftime(b::TIMESTAMP, '%Y-%m-%dT') || '23:59:59.999999+00:00'") + " AS high", spans)


def coerced():
    """bool, number, day and text of a value by the field's type; all null where it does not fit."""
    price, key = F.concat(F.lit(" "), C("o_custkey").cast("string"), F.lit(".5 ")), KEY()
    value = chosen(key, C("o_custkey"), price, C("o_orderstatus"), F.when(C("o_orderstatus") == "O", " True").otherwise("NO"), F.date_format("o_orderdate", "yyyy-MM-dd'T07:08'"), C("o_orderpriority"), F.concat(F.lit("  "), C("o_orderpriority"), F.lit(" ")), F.nullif(F.lit("   "), C("o_orderstatus")))
    kind = chosen(key, *map(F.lit, ("number", "number", "boolean", "boolean", "date", "number", "string", "string")))
    v = F.lower(X.strip(value))
    b = F.when(v.isin("true", "yes", "1"), True).when(v.isin("false", "no", "0"), False)
    return dict(
        type=kind, flag=F.when(kind == "boolean", b), num=F.when(kind == "number", F.trim(value).try_cast("double")),
        day=F.when(kind == "date", D.iso_date(value)), text=F.when(kind == "string", F.nullif(X.strip(value), F.lit(""))),
    )


on("coerce_values", "orders", "o_orderkey", """['number', 'number', 'boolean', 'boolean', 'date', 'number', 'string', 'string'][o_custkey % 8 + 1] AS type, CASE WHEN o_custkey % 8 = 3 THEN o_orderstatus = 'O' END AS flag,
   CASE o_custkey % 8 WHEN 0 THEN o_custkey::DOUBLE WHEN 1 THEN o_custkey + 0.5 END::DOUBLE AS num, CASE WHEN o_custkey % 8 = 4 THEN o_orderdate::DATE END AS day, CASE WHEN o_custkey % 8 = 6 THEN o_orderpriority END AS text""", coerced)  # fmt: skip
