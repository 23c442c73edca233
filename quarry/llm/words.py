"""Word-level column expressions. Words are the maximal runs of [^\\x20\\x09-\\x0D]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, WORD_GAP

#: Descending powers of two: the steps of a binary search over an array of any length.
STEPS = [1 << i for i in range(30, -1, -1)]


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(text.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def bisect(sorted_array: Column, goes_on) -> Column:
    """The last index whose element satisfies goes_on (true for a prefix of the array), or -1."""
    steps = F.array(*(F.lit(s) for s in STEPS))
    return F.aggregate(steps, F.lit(-1), lambda at, s: F.when(F.coalesce(goes_on(F.get(sorted_array, at + s)), F.lit(False)), at + s).otherwise(at))


def covered_by_repeats(keys: Column, width: int) -> Column:
    """How many elements lie in windows (one key each, in text order) that occur twice or more. The keys are sorted with
    their places once; equal neighbours mark the places."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluates value once

    def of_sorted(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["key"] == x["key"], F.lit(False))
        twice = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b))

    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(placed, of_sorted)).cast("long")
