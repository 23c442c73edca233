"""A source that lists objects page by page behind a cursor, as a Spark data source, and the contract of a connector."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.operators.schema import infer_schema

#: kind ("data_source", "page", "row" with the id of a source, or "block" with the id of the page or block above), that id, cursor, size -> {results, has_more, next_cursor}
Fetch = Callable[[str, str | None, str | None, int], dict]
PAGE = 100
# Fixed value: the name of a source that has none.
UNTITLED = "Untitled Data Source"


def pages_of(fetch: Fetch, kind: str, source_id: str | None = None, size: int = PAGE) -> list[dict]:
    """All results, until there is no more or no usable cursor. A source that fails has none."""
    found, cursor = [], None
    try:
        while True:
            said = fetch(kind, source_id, cursor, size)
            found.extend(said.get("results", []))
            cursor = said.get("next_cursor")
            if not said.get("has_more") or not isinstance(cursor, str) or not cursor:
                return found
    except Exception:  # noqa: BLE001  whatever a client raises
        return []


def title_of(result: dict) -> str:
    title = result.get("title")
    first = title[0] if isinstance(title, list) and title else None
    text = (first.get("plain_text") or (first.get("text") or {}).get("content")) if isinstance(first, dict) else None
    return text if isinstance(text, str) and text else UNTITLED


def reachable(fetch: Fetch | None) -> bool:
    """Whether a first page of one result can be read."""
    if fetch is None:
        return False
    try:
        fetch("page", None, None, 1)
        return True
    except Exception:  # noqa: BLE001
        return False


class Listing(DataSource):
    """Options: client (`module:factory`, which returns a Fetch on the executor), kind, and for rows source_ids as a JSON
    list; one partition a listing, as a cursor is a chain. A client that is not there lists nothing."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "kind string, source_id string, pos long, id string, title string, parent map<string,string>, json string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.kind = options.get("client"), options.get("kind", "page")
        self.sources = json.loads(options.get("source_ids", "[null]"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.sources]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.client:
            return
        module, factory = self.client.split(":")
        fetch = getattr(import_module(module), factory)()
        for pos, r in enumerate(pages_of(fetch, self.kind, partition.value)):
            parent = r.get("parent") if isinstance(r.get("parent"), dict) else {}
            texts = {k: v for k, v in parent.items() if isinstance(v, str)}
            yield self.kind, partition.value, pos, r.get("id") if isinstance(r.get("id"), str) else None, title_of(r), texts, json.dumps(r)


def listed(spark: SparkSession, client: str | None, kind: str, source_ids: list[str] | None = None) -> DataFrame:
    """kind, source_id, pos, id, title, parent, json of what the client lists; data sources without an id are left out."""
    spark.dataSource.register(Listing)
    reader = spark.read.format("listing").option("kind", kind)
    if client:
        reader = reader.option("client", client)
    if source_ids is not None:
        reader = reader.option("source_ids", json.dumps(source_ids))
    out = reader.load()
    return out.filter("id IS NOT NULL") if kind == "data_source" else out


class Connector(Protocol):
    """What a source of documents offers: documents (id, title, content, last_edited_time, properties)."""

    def fetch_documents(self, spark: SparkSession) -> DataFrame: ...


def describe_schema(connector: Connector, spark: SparkSession, documents: DataFrame | None = None) -> DataFrame:
    """The schema of a connector's documents, given or fetched."""
    return infer_schema(connector.fetch_documents(spark) if documents is None else documents)


class TableConnector:
    """Documents of a Parquet table."""

    def __init__(self, path: str):
        self.path = path

    def fetch_documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).select("id", "title", "content", "last_edited_time", F.col("properties"))
