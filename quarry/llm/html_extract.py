"""HTML extraction by wrappers inferred per host. Pages are token streams of tags and texts (html_tree). The streams of a
host are aligned one after the other into a union-free regular expression (wrappers): what differs becomes a text slot,
an optional node or a repeated group. Each page is then matched against its host's wrapper, and the texts that fall on
its fields are the page's text: where nothing is marked as the article, the wrapper tells it by where nearly all of the
host's running text stands. Element names and labels (menu, header, advert, ...) only say which slots are no fields.

A task aligns the pages that it reads itself and sends one wrapper a host (several where it meets very many hosts), so a
frequent host sends no more than any other; these are aligned in salted parts, then the parts, as a stream of which one
wrapper is held. Wrappers are broadcast while their written size is under broadcast_bytes; beyond, pages and wrappers meet
by host and salt.

Defined results: a null html is empty; a page without text gives an empty string; a null url has the host ''; broken and
unclosed markup is read as far as it goes; elements nested deeper than 64 count as their 64th ancestor's text; very long
pages take time in proportion to their length; repeated rows are extracted each; the order of pages can change how a
wrapper groups its optional parts, not what it accepts; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import in_parts
from quarry.llm.common import partitions, small_batches, written
from quarry.llm.html_tree import parse
from quarry.llm.url_filter import url_host_path
from quarry.llm.wrappers import TEXT, Level, aligned, fields, main_text

ROWS = "host string, wrapper string"
#: A task sends its wrappers when they have as many characters.
HELD = 16 << 20


def hashed(nodes: list[list]) -> list[list]:
    """A page's tree as a wrapper that accepts this page: texts by their hash."""
    return [[n[0], blake2b(n[1].encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if n[0] == TEXT else hashed(n[1]), *n[2:]] for n in nodes]


def _rows(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "wrapper"])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for the pages of each host that this task reads."""
    found: dict[str, list] = {}
    size = 0
    for batch in batches:
        for part in in_parts(batch, 1):
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tree = hashed(parse(page or ""))
                if host in found:
                    found[host] = aligned(found[host], tree)
                else:
                    found[host] = tree
                    size += 1000 + len(page or "")
                if size > HELD:
                    yield _rows(found)
                    found, size = {}, 0
    if found:
        yield _rows(found)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the sorted wrappers of each host into one; only that one is held."""
    host, wrapper, any_yet = None, [], False
    for batch in batches:
        for h, w in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if any_yet and h == host:
                wrapper = aligned(wrapper, json.loads(w))
                continue
            if any_yet:
                yield _rows({host: wrapper})
            host, wrapper, any_yet = h, json.loads(w), True
    if any_yet:
        yield _rows({host: wrapper})


def infer_wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host and wrapper (nodes as JSON) of pages with host and html."""
    spark = pages.sparkSession
    small_batches(spark)
    n = partitions(spark)
    seen = written(pages.select("host", "html").mapInArrow(_observe, ROWS), "html-seen")
    parts = seen.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    parts = parts.select("host", "wrapper").mapInArrow(_fold, ROWS)
    return parts.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_fold, ROWS)


@lru_cache(maxsize=256)
def _level(wrapper: str) -> Level:
    return fields(json.loads(wrapper))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in in_parts(batch, 2):
            texts = [main_text(parse(p or ""), _level(w)) for p, w in zip(*(part.column(i).to_pylist() for i in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, broadcast_bytes: int = 32 << 20, salts: int = 16) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html", url_host_path(F.col("url"))[0].alias("host"))
    wrappers = written(infer_wrappers(pages, salts), "html-wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        out = pages.join(F.broadcast(wrappers), "host", "left")
    else:
        wrappers = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = pages.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(salts)).cast("int")).join(wrappers.hint("merge"), ["host", "salt"], "left")
    return out.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
