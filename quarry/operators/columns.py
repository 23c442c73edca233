"""Typed columns of properties: the map of tagged values shredded into plain Parquet columns, so that filters on properties
become predicates that reach the scan (pushed filters, row-group statistics, Bloom filters, column pruning).

A property gets the columns of the kinds of value that it was seen with: `name__text` and `name__norm` (as a filter in memory
compares it), `name__day` if some text is a date, `name__num`, `name__flag`, `name__items` and `name__norms`. Nothing is lost
or coerced: a value of every kind that was seen has its column, so predicates on columns and on the map agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import iso_date
from quarry.functions.text import strip

SEP = "__"
#: Columns of the kinds of value (as quarry.operators.schema.seen counts them).
OF_KIND = {"plain": ("text", "norm"), "dated": ("text", "norm", "day"), "number": ("num", "norm"), "flag": ("flag", "norm"), "list": ("items", "norms")}
TYPES = {"text": "string", "norm": "string", "day": "date", "num": "double", "flag": "boolean", "items": "array<string>", "norms": "array<string>"}
#: Those on which equality is asked.
BLOOM = ("text", "norm", "num")


def normal(text: Column) -> Column:
    return F.lower(strip(text))


def wanted(seen: DataFrame) -> list[str]:
    """The columns for what was seen (name and counts of kinds): a schema is a few rows."""
    rows = seen.select("name", *(F.coalesce(F.col(k) > 0, F.lit(False)).alias(k) for k in OF_KIND)).collect()
    return sorted({f"{r['name']}{SEP}{c}" for r in rows for k, cs in OF_KIND.items() if r[k] for c in cs})


def kind_of(column: str) -> str:
    return TYPES[column.rpartition(SEP)[2]]


def ddl(columns: list[str]) -> str:
    return "".join(f", `{c}` {kind_of(c)}" for c in columns)


def shred(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the typed columns (anew where they have them), from their map `properties`."""

    def value(column: str) -> Column:
        name, _, part = column.rpartition(SEP)
        v = F.try_element_at(F.col("properties"), F.lit(name))
        is_kind = lambda k: v["kind"] == k
        return {
            "text": lambda: F.when(is_kind("string"), v["text"]), "norm": lambda: F.when(~is_kind("list"), normal(v["text"])), "day": lambda: F.when(is_kind("string"), iso_date(v["text"])),
            "num": lambda: F.when(is_kind("number"), v["num"]), "flag": lambda: F.when(is_kind("boolean"), v["flag"]),
            "items": lambda: F.when(is_kind("list"), v["items"]), "norms": lambda: F.when(is_kind("list"), F.transform(v["items"], normal)),
        }[part]()

    return rows.drop(*columns).select("*", *(value(c).cast(kind_of(c)).alias(c) for c in columns))


def parts(field: str, columns: list[str]) -> dict[str, Column]:
    """The typed columns of a field that rows with these columns have; none if it is not provided."""
    found = {c.rpartition(SEP)[2]: c for c in columns if SEP in c and c.rpartition(SEP)[0] == field and c.rpartition(SEP)[2] in TYPES}
    return {part: F.col(f"`{c}`") for part, c in found.items()}


def write(rows: DataFrame, columns: list[str], path: str) -> None:
    """A Parquet table with these columns beside the rows' own, with Bloom filters on those of equality."""
    writer = shred(rows, columns).write
    for c in columns:
        if c.rpartition(SEP)[2] in BLOOM:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
