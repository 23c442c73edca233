"""Date functions as column expressions. `today` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import collapse, let, normalize

#: Month names, and their numbers by place.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def iso_date(text: Column) -> Column:
    """The date that the first ten characters state as YYYY-MM-DD, YYYYMMDD (up to ten characters) or YYYY-Www-D."""
    head = F.left(F.trim(text), F.lit(10))
    plain = F.when(F.rlike(head, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(head, "yyyy-MM-dd"))
    compact = F.when(F.rlike(head, F.lit(r"^[0-9]{8}$")), F.try_to_date(head, "yyyyMMdd"))
    week = F.when(F.rlike(head, F.lit(r"^[0-9]{4}-W[0-9]{2}-[1-7]$")), _week_date(head))
    return F.coalesce(plain, compact, week)


def _week_date(text: Column) -> Column:
    year, week, day = (F.substr(text, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 4), (7, 2), (10, 1)))
    monday = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    found = F.date_add(monday, (week - 1) * 7 + day - 1)
    return F.when((week >= 1) & (F.extract(F.lit("YEAROFWEEK"), found) == year), found)


def is_iso_date(text: Column) -> Column:
    """Whether a text of ten characters or more begins with a date."""
    return F.coalesce((F.length(text) >= 10) & iso_date(text).isNotNull(), F.lit(False))


def week_span(day: Column) -> tuple[Column, Column]:
    low = F.date_trunc("week", day).cast("date")
    return low, F.date_add(low, 6)


def month_span(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "MM"), F.last_day(day)


def snap(day: Column, unit: Column) -> tuple[Column, Column]:
    """The whole week or month of a day; null for other units."""
    (a, b), (c, d) = week_span(day), month_span(day)
    return F.when(unit == "week", a).when(unit == "month", c), F.when(unit == "week", b).when(unit == "month", d)


def utc_bounds(low: Column, high: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """First and last microsecond, in UTC, of a span of days in a zone."""
    start = F.to_utc_timestamp(F.to_timestamp_ntz(low.cast("string"), F.lit("yyyy-MM-dd")).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.to_timestamp_ntz(F.date_add(high, 1).cast("string"), F.lit("yyyy-MM-dd")).cast("timestamp"), zone)
    return start, end - F.expr("INTERVAL 1 MICROSECOND")


def rfc3339(instant: Column) -> Column:
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(instant, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def replace_year(day: Column, year: Column) -> Column:
    """The same day of another year; 29 February becomes the 28th where that year has none."""
    first = F.make_date(year, F.month(day), F.lit(1))
    return F.date_add(first, F.least(F.dayofmonth(day), F.dayofmonth(F.last_day(first))) - 1)


def clamp_year(day: Column, today: Column) -> Column:
    """The latest occurrence of the month and day that is not after today."""
    this = replace_year(day, F.year(today))
    return F.when(this > today, replace_year(day, F.year(today) - 1)).otherwise(this)


def normalize_date_token(token: Column) -> Column:
    """Y-M-D or D-M-Y, with - or /, as zero-padded ISO text; no calendar check."""
    ymd, dmy = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$"
    part = lambda p, i, n: F.lpad(F.regexp_extract(token, p, i), n, "0")
    return F.when(F.rlike(token, F.lit(ymd)), F.concat_ws("-", part(ymd, 1, 4), part(ymd, 2, 2), part(ymd, 3, 2))).when(
        F.rlike(token, F.lit(dmy)), F.concat_ws("-", part(dmy, 3, 4), part(dmy, 2, 2), part(dmy, 1, 2))
    )


def resolve_phrase(phrase: Column, today: Column) -> Column:
    """A closed grammar of English date phrases; null for anything else. Month phrases without a year mean the latest
    such day up to today."""
    return let(normalize(phrase), lambda p: _resolve(p, today))


def _resolve(p: Column, today: Column) -> Column:
    count, unit = F.regexp_extract(p, r"^([0-9]{1,4}) (day|week|month|year)s? ago$", 1), F.regexp_extract(p, r"^([0-9]{1,4}) (day|week|month|year)s? ago$", 2)
    n = F.nullif(count, F.lit("")).cast("int")
    named = r"^([a-z]+) ([0-9]{1,2})(?:,? ([0-9]{4}))?$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(p, named, 1)).cast("int")
    number = F.nullif(F.regexp_extract(p, named, 2), F.lit("")).cast("int")
    year = F.nullif(F.regexp_extract(p, named, 3), F.lit("")).cast("int")
    named_day = F.try_to_date(F.concat_ws("-", F.lpad(F.coalesce(year, F.lit(2000)).cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(number.cast("string"), 2, "0")), "yyyy-MM-dd")
    return (
        F.when(p == "today", today)
        .when(p == "yesterday", F.date_sub(today, 1))
        .when(p == "day before yesterday", F.date_sub(today, 2))
        .when(unit == "day", F.date_sub(today, n))
        .when(unit == "week", F.date_sub(today, n * 7))
        .when(unit == "month", F.add_months(today, -n))
        .when(unit == "year", F.add_months(today, -12 * n))
        .when(p.isin("this week", "this month"), today)
        .when(p == "last week", F.date_sub(today, 7))
        .when(p == "last month", F.add_months(today, -1))
        .when(month > 0, F.when(year.isNotNull(), named_day).otherwise(clamp_year(named_day, today)))
        .otherwise(iso_date(F.when(F.length(p) == 10, F.upper(p))))
    )


def temporal_bounds(kind: Column, unit: Column, anchor: Column, query: Column, today: Column, zone: str = "UTC") -> Column:
    """Struct of the UTC bounds low and high of a described span as text, or null: the anchor must occur in the query and
    resolve; a range needs a known unit."""
    said = (F.length(collapse(anchor)) > 0) & F.contains(normalize(query), normalize(anchor))
    whole = F.lower(F.trim(F.when(F.length(kind) > 0, kind).otherwise("single"))) == "range"

    def of(day: Column) -> Column:
        low, high = snap(day, F.lower(F.trim(unit)))
        start, end = utc_bounds(F.when(whole, low).otherwise(day), F.when(whole, high).otherwise(day), zone)
        return F.when(start.isNotNull(), F.struct(rfc3339(start).alias("low"), rfc3339(end).alias("high")))

    return let(F.when(said, resolve_phrase(anchor, today)), of)
