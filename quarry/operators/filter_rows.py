"""Filters as data: the filter lists of all requests become a table of predicates, which is joined with the values of the
rows and counted per list (a relational division). The plan has the same size for one list and for any number."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.dates import iso_date
from quarry.functions.text import strip
from quarry.operators.columns import normal
from quarry.operators.predicates import OPERATORS, RANGES, SYSTEM_FIELDS, Filter, _date_text, _index_bounds, _listed, _number, _stored
from quarry.storage import written

#: Lists are numbered in so many parts, so that no task sorts all of them.
PARTS = 1024
#: how: key (equality, by `key`), or a range over instants, numbers or (in memory) days or numbers, by operator and bounds.
KIND = "filter_set long, n int, i int, field string, how string, key string, num double, operator string, low string, high string, low_num double, high_num double"


def filter_sets(requests: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """filter_set (long) and list (JSON) of the distinct filter lists, None if there is none, and the requests with the
    filter_set of theirs (-1: none) in place of filters."""
    if "filters" not in requests.columns:
        return None, requests.withColumn("filter_set", F.lit(-1).cast("long"))
    keyed = requests.withColumn("_list", F.when(F.size("filters") > 0, F.to_json("filters")))
    part = F.pmod(F.xxhash64("list"), F.lit(PARTS))
    lists = keyed.select(F.col("_list").alias("list")).filter("list IS NOT NULL").distinct().withColumn("part", part)
    nth = F.row_number().over(W.partitionBy("part").orderBy("list")) - 1
    sets = written(lists.select((F.col("part") + PARTS * nth.cast("long")).alias("filter_set"), "list"), "filter-lists")
    if sets.isEmpty():
        return None, keyed.withColumn("filter_set", F.lit(-1).cast("long")).drop("_list", "filters")
    asked = keyed.join(sets.withColumnRenamed("list", "_list"), "_list", "left").drop("_list", "filters")
    return sets, asked.withColumn("filter_set", F.coalesce("filter_set", F.lit(-1)))


def parsed(said: dict) -> Filter:
    """A filter of a request: value or values, as the type says where there is one."""
    value = said.get("values", said.get("value"))
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    if said.get("type") == "boolean" and isinstance(value, str):
        value = value == "true"
    elif said.get("type") == "number":
        value = [float(v) for v in value] if isinstance(value, list) else float(value)
    return Filter(said["field"], said["operator"], value)


def _predicates(f: Filter, mode: str) -> Iterator[dict]:
    """The rows of one filter: one for each value that equality accepts, one for a range, none if nothing can pass."""
    if f.operator not in OPERATORS:
        raise ValueError(f"unsupported filter operator: {f.operator}")
    if f.operator not in RANGES:
        for w in f.value if _listed(f.value) else [f.value]:
            if mode == "memory":
                yield {"how": "key", "key": "s:" + str(w).strip().lower()}
            elif isinstance(w, bool):
                yield {"how": "key", "key": f"b:{str(w).lower()}"}
            elif isinstance(w, (int, float)):
                yield {"how": "key", "num": float(w)}
            else:
                yield {"how": "key", "key": f"s:{w}"}
        return
    if mode == "memory":
        bounds = list(f.value) if f.operator == "between" and isinstance(f.value, (list, tuple)) else [f.value]
        if len(bounds) == (2 if f.operator == "between" else 1):
            days = [date.fromisoformat(b.strip()[:10]).isoformat() if _date_text(b) else None for b in bounds]
            yield {"how": "memory", "low": days[0], "high": days[-1], "low_num": _number(bounds[0]), "high_num": _number(bounds[-1])}
        return
    bounds = _index_bounds(f)
    if any(map(_date_text, bounds)):
        yield {"how": "instants", "low": str(bounds[0]), "high": str(bounds[-1])}
    else:
        yield {"how": "numbers", "low_num": _number(bounds[0]), "high_num": _number(bounds[-1])}


def predicates(sets: DataFrame, mode: str) -> DataFrame:
    """The predicates of the lists. A malformed filter stops the job, as compile_filters refuses it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in KIND.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in KIND.split(", ")]
        for batch in batches:
            rows = []
            for own, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filters = [parsed(x) for x in json.loads(said)]
                for i, f in enumerate(filters):
                    rows += [{"filter_set": own, "n": len(filters), "i": i, "field": f.field, "operator": f.operator} | p for p in _predicates(f, mode)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    out = sets.select("filter_set", "list").mapInArrow(run, KIND)
    return out.withColumn("key", F.coalesce("key", _number_key(F.col("num")))).drop("num")


def _number_key(number: Column) -> Column:
    """Equal numbers have equal keys (zeros of both signs)."""
    return F.concat(F.lit("n:"), (number + F.lit(0.0)).cast("string"))


def _values(rows: DataFrame) -> DataFrame:
    """chunk_id, field and v (a tagged value) of the properties and the system fields of rows."""
    own = F.filter(F.map_entries("properties"), lambda e: ~e["key"].isin(*SYSTEM_FIELDS))
    kind = rows.select(own.alias("x")).schema["x"].dataType.simpleString()
    system = [F.array(F.struct(F.lit(name).alias("key"), _stored(Filter(name, "equals", ""), rows.columns).alias("value"))).cast(kind) for name in SYSTEM_FIELDS if name in rows.columns]
    none = F.array().cast(kind)
    return rows.select("chunk_id", F.explode(F.concat(F.coalesce(own, none), *system)).alias("e")).select("chunk_id", F.col("e.key").alias("field"), F.col("e.value").alias("v")).filter("v IS NOT NULL")


def _compared(value: Column, low: Column, high: Column) -> Column:
    op = F.col("operator")
    return F.when(op == "between", value.between(low, high)).when(op == "gt", value > low).when(op == "gte", value >= low).when(op == "lt", value < low).otherwise(value <= low)


def _in_range(mode: str) -> Column:
    v, low, high = F.col("v"), F.col("low_num"), F.col("high_num")
    if mode == "memory":
        day = F.when(v["kind"] == "string", iso_date(v["text"]))
        number = F.when(v["kind"] == "boolean", v["flag"].cast("double")).when(v["kind"] == "number", v["num"]).when(v["kind"] == "string", strip(v["text"]).try_cast("double"))
        return (v["kind"] != "list") & F.when(day.isNotNull(), _compared(day, F.col("low").cast("date"), F.col("high").cast("date"))).otherwise(_compared(number, low, high))
    texts = F.when(v["kind"] == "list", v["items"]).otherwise(F.array(F.when(v["kind"] == "string", v["text"])))
    instant = F.exists(texts, lambda x: F.coalesce(_compared(F.try_to_timestamp(x), F.try_to_timestamp("low"), F.try_to_timestamp("high")), F.lit(False)))
    return F.when(F.col("how") == "instants", instant).otherwise((v["kind"] == "number") & _compared(v["num"], low, high))


def _keys(mode: str) -> Column:
    """The keys of equality that a value answers to."""
    v = F.col("v")
    said = lambda x: F.concat(F.lit("s:"), x)
    if mode == "memory":
        return F.when(v["kind"] == "list", F.transform(v["items"], lambda x: said(normal(x)))).otherwise(F.array(said(normal(v["text"]))))
    one = F.when(v["kind"] == "boolean", F.concat(F.lit("b:"), v["flag"].cast("string"))).when(v["kind"] == "number", _number_key(v["num"])).when(v["kind"] == "string", said(v["text"]))
    return F.when(v["kind"] == "list", F.transform(v["items"], said)).otherwise(F.array(one))


def passing(rows: DataFrame, sets: DataFrame, mode: str) -> DataFrame:
    """chunk_id and filter_set wherever a row (chunk_id, properties, perhaps system fields) passes all filters of a list: what
    compile_filters decides, for all lists at once. Equality is an equi-join on field and value, a range one on the field.
    The predicates are a written table, so Spark knows its size and broadcasts it only if it is small. Only matches move."""
    asked = written(predicates(sets, mode), "predicates")
    values = _values(rows)
    equal = values.select("chunk_id", "field", F.explode(F.array_distinct(_keys(mode))).alias("key")).join(asked.filter("how = 'key'").select("field", "key", "filter_set", "i", "n"), ["field", "key"])
    ranged = values.join(asked.filter("how <> 'key'").drop("key"), "field").filter(_in_range(mode))
    columns = ("chunk_id", "filter_set", "i", "n")
    met = equal.select(*columns).unionAll(ranged.select(*columns)).groupBy("chunk_id", "filter_set").agg(F.size(F.collect_set("i")).alias("met"), F.max("n").alias("n"))
    return met.filter("met = n").select("chunk_id", "filter_set")
