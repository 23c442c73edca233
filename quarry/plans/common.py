"""What registered queries share: the tables, the corpus built on them, and SQL fragments that state the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import SPACES

SQL_WORD = f"[^{SPACES}]+"
TODAY = "2024-02-29"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_WORD}')"


def sql_collapse(text: str) -> str:
    return f"array_to_string({sql_words(text)}, ' ')"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"


def sql_sentences(text: str) -> str:
    """No look-behind in RE2: sentence ends are marked first, marks after abbreviations taken back."""
    space = r"[ \t\n\x0b\f\r]+"
    marked = rf"regexp_replace({text}, '([.!?])({space})([A-Z\"(\[])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    kept = rf"regexp_replace({marked}, '([A-Z][a-z]{{1,2}}\.)\x01({space})\x02', '\1\2', 'g')"
    return rf"string_split(regexp_replace(regexp_replace({kept}, '\x01{space}\x02', chr(1), 'g'), '\x02', '', 'g'), chr(1))"


def sql_packed(name: str, parts: str, joint: str, most: int = 250) -> str:
    """CTEs (of a WITH RECURSIVE) that pack parts (key, parts as a list) greedily: {name}_g has key, i, body and whether the body
    is one part that is too long. A chain of cuts is followed: each next cut is found in the prefix sums of word counts."""
    return f"""{name}_n AS (SELECT key, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM ({parts})),
{name}_l AS (SELECT key, list(part ORDER BY i) AS parts, list(n ORDER BY i) AS ns, list(s ORDER BY i) AS sums FROM (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY i) AS s FROM (SELECT *, len({sql_words('part')}) AS n FROM {name}_n)) GROUP BY key),
{name}_c AS (SELECT key, 1::BIGINT AS i FROM {name}_l UNION ALL SELECT key, cut FROM (
  SELECT key, i + CASE WHEN ns[i] > {most} THEN 1 ELSE len(list_filter(sums[i:], lambda x: x - sums[i] + ns[i] <= {most})) END AS cut, len(ns) AS l FROM {name}_c JOIN {name}_l USING (key)) WHERE cut <= l),
{name}_g AS (SELECT key, i, array_to_string(parts[i:e - 1], {joint}) AS body, ns[i] > {most} AS long FROM (
  SELECT key, i, coalesce(lead(i) OVER (PARTITION BY key ORDER BY i), len(ns) + 1) AS e, parts, ns FROM {name}_c JOIN {name}_l USING (key)))"""


def sql_by_sentences(name: str, texts: str, most: int = 250) -> str:
    """CTEs up to {name}(key, i, j, body) from texts (key, text)."""
    parts = f"SELECT key, list_filter(list_transform({sql_sentences('text')}, lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts FROM ({texts})"
    sliced = f"SELECT key, i, unnest(range(0, len(ws), {most})) AS j, ws FROM (SELECT key, i, {sql_words('body')} AS ws FROM {name}_g WHERE long)"
    return f"""{sql_packed(name, parts, "' '", most)},
{name} AS (SELECT key, i, 0 AS j, body FROM {name}_g WHERE NOT long UNION ALL SELECT key, i, j, array_to_string(ws[j + 1:j + {most}], ' ') FROM ({sliced}))"""


def sql_by_paragraphs(name: str, texts: str, most: int = 250) -> str:
    """CTEs up to {name}(key, i, j, k, body) from texts (key, text); keys are texts."""
    parts = f"SELECT key, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts FROM ({texts})"
    joint = "chr(10) || chr(10)"
    inner = sql_by_sentences(f"{name}_s", f"SELECT key || ':' || i AS key, body AS text FROM {name}_g WHERE long", most)
    return f"""{sql_packed(name, parts, joint, most)},
{inner},
{name} AS (SELECT key, i, 0 AS j, 0 AS k, body FROM {name}_g WHERE NOT long UNION ALL SELECT g.key, g.i, s.i, s.j, s.body FROM {name}_g g JOIN {name}_s s ON s.key = g.key || ':' || g.i WHERE g.long)"""


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small literal table without Python on the executors; columns as a DDL schema."""
    names = [c.strip().split(" ", 1) for c in columns.split(",")]
    literal = lambda v, t: F.lit(list(v) if isinstance(v, tuple) else v).cast(t)
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*(F.struct(*(literal(v, t).alias(n) for v, (n, t) in zip(row, names, strict=True))) for row in rows))))


def sql_values(columns: str, rows: list[tuple]) -> str:
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]"}
    names = [c.strip().split(" ", 1) for c in columns.split(",")]

    def literal(v, t: str) -> str:
        if v is None:
            return f"NULL::{kinds[t]}"
        if isinstance(v, tuple):
            return "[" + ", ".join(literal(x, "string") for x in v) + "]::VARCHAR[]"
        if isinstance(v, (bool, int, float)):
            return f"{str(v).lower()}::{kinds[t]}"
        return "'" + str(v).replace("'", "''") + f"'::{kinds[t]}"

    body = ", ".join("(" + ", ".join(literal(v, t) for v, (_, t) in zip(row, names, strict=True)) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(n for n, _ in names)}))"
