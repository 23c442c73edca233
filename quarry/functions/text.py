"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters and the four ASCII separators, for Java and RE2 patterns alike.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACES}]"
#: The same characters as a string.
SPACE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at the ends; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Runs without white space, by splitting, which is several times faster than collecting matches."""
    return let(strip(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+", -1)))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.array_join(words(text), " ")


def normalize(text: Column) -> Column:
    return F.lower(collapse(text))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def camel_case(name: Column) -> Column:
    """`Leetcode Topic` -> `leetcodeTopic`."""
    parts = F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), 0)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(capitalized(p))), "")


def decamel(name: Column) -> Column:
    """`leetcodeTopic` -> `leetcode topic`."""
    apart = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.lower(strip(F.translate(apart, "_", " ")))


def surface_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}]", "")


def slug(text: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0), "-"))


def dequote(value: Column) -> Column:
    """One pair of equal quotes around a value of two characters or more goes."""
    first, last = F.left(value, F.lit(1)), F.right(value, F.lit(1))
    quoted = (F.length(value) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def clean_value(value: Column) -> Column:
    return strip(F.btrim(dequote(strip(value)), F.lit(".,;:!?")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def snippet(text: Column, most: int = 200) -> Column:
    return F.left(collapse(text), F.lit(most))


def report_snippet(text: Column, most: int = 400) -> Column:
    return let(collapse(text), lambda whole: F.when(F.length(whole) <= most, whole).otherwise(F.concat(strip(F.left(whole, F.lit(most))), F.lit("…"))))


def point_id(chunk_id: Column) -> Column:
    """Version 5 UUID of the chunk id under the URL namespace, from the built-in SHA-1."""
    space = F.lit(bytearray.fromhex("6ba7b8119dad11d180b400c04fd430c8"))  # fixed value: the namespace of URLs

    def of(digest: Column) -> Column:
        at = lambda a, n: F.substr(digest, F.lit(a), F.lit(n))
        variant = F.lower(F.hex((F.conv(at(17, 1), 16, 10).cast("int") % 4) + 8))
        return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(variant, at(18, 3)), at(21, 12))

    return let(F.sha1(F.concat(space, F.encode(chunk_id, "UTF-8"))), of)


def sentences(text: Column) -> Column:
    """Split at white space (of any script) after . ! ? and before a capital, quote or bracket, but not after a capital with
    one or two small letters and a full stop."""
    # Fixed value: where a sentence ends. The look that most places fail comes first.
    return F.split(text, rf'(?<=[.!?])(?<![A-Z][a-z]\.)(?<![A-Z][a-z][a-z]\.){SPACE}+(?=[A-Z"(\[])')
