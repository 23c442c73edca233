"""A table that changes by small batches and is merged when it is read.

A write never touches what is stored: it appends a segment of rows and, if it takes rows out, a segment of tombstones (keys
that are gone), each under the number of the write. A row lives unless a tombstone of its key has a higher number. The list
of segments is a manifest, a small file for each version; a version counts once its manifest is there, so a job that dies
halfway changes nothing, and readers of the version before are not disturbed. Compaction rewrites a run of the newest
segments that are small beside each other into one, without their dead rows; tombstones go when nothing older is left.

One writer at a time: of two that race, the later one finds its version taken and raises FileExistsError; its segments are
unreferenced until vacuum() deletes them."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage

NUMBER = "_number"
GONE = f"target string, key string, {NUMBER} long"
#: What a task of a compaction sorts at most: stored bytes, which are compressed, and rows.
PART_BYTES, PART_ROWS = 1 << 27, 1 << 19


@dataclass(frozen=True)
class Segment:
    """number: of the write; kind: rows or gone; targets: the columns that tombstones name; facts: sums that the writer
    keeps of its rows."""

    name: str
    kind: str
    number: int
    rows: int
    size: int
    targets: tuple[str, ...] = ()
    facts: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    """columns: DDL of the rows; keys: columns (texts) that tombstones can name."""

    spark: SparkSession
    path: str
    columns: str
    keys: tuple[str, ...]
    #: Columns with Parquet Bloom filters, and the order of rows in a segment's files.
    bloom: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    # versions

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]

    def _said(self, version: int | None) -> dict:
        there = self.versions()
        if not there:
            return {"segments": [], "note": {}}
        return json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{there[-1] if version is None else version:010d}.json"))

    def segments(self, version: int | None = None) -> list[Segment]:
        """Of a version, by default the last; none if nothing was ever written."""
        return [Segment(**(s | {"targets": tuple(s["targets"])})) for s in self._said(version)["segments"]]

    def note(self) -> dict:
        """What the last write was told to remember."""
        return self._said(None)["note"]

    def exists(self) -> bool:
        return bool(self.versions())

    def commit(self, segments: list[Segment], note: dict | None = None) -> int:
        version, note = max(self.versions(), default=0) + 1, self.note() if note is None else note
        storage.put_text(self.spark, f"{self.path}/manifest/{version:010d}.json", json.dumps({"segments": [asdict(s) for s in segments], "note": note}))
        return version

    def rollback(self, version: int) -> None:
        """Forgets the versions after one; their segments go with the next vacuum()."""
        for v in self.versions():
            if v > version:
                storage.delete(self.spark, f"{self.path}/manifest/{v:010d}.json")

    # rows

    def _at(self, s: Segment) -> str:
        return f"{self.path}/{s.kind}/{s.name}"

    def _put(self, df: DataFrame, kind: str, number: int, **more) -> Segment:  # noqa: ANN003
        made = Segment(f"{number:010d}-{uuid.uuid4().hex}", kind, number, 0, 0, **more)
        writer = df.write
        for c in self.bloom if kind == "rows" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(self._at(made))
        rows = self.spark.read.schema(df.schema).parquet(self._at(made)).count()
        return Segment(made.name, kind, number, rows, storage.size_of(self.spark, self._at(made)), **more)

    def _scan(self, segments: list[Segment]) -> DataFrame:
        kind = f"{self.columns}, {NUMBER} long"
        if not segments:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*map(self._at, segments))

    def gone(self, segments: list[Segment]) -> DataFrame:
        """target, key and the last number under which it went."""
        paths = [self._at(s) for s in segments if s.kind == "gone"]
        read = self.spark.read.schema(GONE).parquet(*paths) if paths else self.spark.createDataFrame([], GONE)
        return read.groupBy("target", "key").agg(F.max(NUMBER).alias(NUMBER))

    def _live(self, rows: list[Segment], segments: list[Segment]) -> DataFrame:
        tombs = [s for s in segments if s.kind == "gone"]
        last = max((s.number for s in tombs), default=0)
        old, new = [s for s in rows if s.number < last], [s for s in rows if s.number >= last]
        if not old:
            return self._scan(new)
        live, dead = self._scan(old), self.gone(segments)
        for target in sorted({t for s in tombs for t in s.targets}):
            keys = dead.filter(F.col("target") == target).select(F.col("key").alias("_key"), F.col(NUMBER).alias("_after"))
            live = live.join(keys, (live[target] == keys["_key"]) & (live[NUMBER] < keys["_after"]), "left_anti")
        return live.unionByName(self._scan(new)) if new else live

    def read(self, version: int | None = None) -> DataFrame:
        segments = self.segments(version)
        return self._live([s for s in segments if s.kind == "rows"], segments).drop(NUMBER)

    def rows_of(self, segment: Segment) -> DataFrame:
        """The rows of one segment, as it was written."""
        return self._scan([segment]).drop(NUMBER)

    def live_of(self, keys: DataFrame, target: str) -> DataFrame:
        """The live rows of given keys (a column `key`). Few keys become a filter that reaches the files' statistics."""
        some = keys.select("key").distinct().limit(1001).collect()
        if len(some) <= 1000:
            return self.read().filter(F.col(target).isin([r["key"] for r in some]))
        return self.read().join(keys.select(F.col("key").alias(target)).distinct(), target, "left_semi")

    def write(self, fresh: DataFrame | None, gone: dict[str, DataFrame] | None = None, facts: dict | None = None, note: dict | None = None) -> Segment | None:
        """Appends rows and takes out the older rows whose column has one of the given texts (column -> texts in a column
        `key`). Both are evaluated once. Returns the segment of rows."""
        segments = self.segments()
        number = 1 + max((s.number for s in segments), default=0)
        made, held = None, []
        if fresh is not None:
            rows = fresh.select(*(c for c in self._scan([]).columns if c != NUMBER)).withColumn(NUMBER, F.lit(number).cast("long"))
            made = self._put(rows.sortWithinPartitions(*self.order) if self.order else rows, "rows", number, facts=facts or {})
            held = [made] if made.rows or made.facts else []
        if gone and any(s.kind == "rows" for s in segments):
            unknown = set(gone) - set(self.keys)
            if unknown:
                raise ValueError(f"no keys of this table: {sorted(unknown)}")
            keys = [k.select(F.lit(t).alias("target"), F.col("key").cast("string").alias("key")) for t, k in gone.items()]
            tomb = reduce(DataFrame.unionByName, keys).filter("key IS NOT NULL").distinct().withColumn(NUMBER, F.lit(number).cast("long"))
            tomb = self._put(tomb, "gone", number, targets=tuple(gone))
            held += [tomb] if tomb.rows else []
        self.commit(segments + held, note)
        return made

    def replace(self, rows: DataFrame, facts: dict | None = None) -> None:
        """A version of these rows alone."""
        number = 1 + max((s.number for s in self.segments()), default=0)
        rows = rows.withColumn(NUMBER, F.lit(number).cast("long"))
        self.commit([self._put(rows.sortWithinPartitions(*self.order) if self.order else rows, "rows", number, facts=facts or {})])

    def facts(self, version: int | None = None) -> dict:
        """The sums of all segments' facts."""
        out: dict = {}
        for s in self.segments(version):
            for k, v in s.facts.items():
                out[k] = out.get(k, 0) + v
        return out

    # upkeep

    def compact(self, least: int = 4, ratio: float = 4.0, whole: bool = False) -> int:
        """Merges the newest segments: a run that is extended to the next older one as long as that is at most `ratio` times
        as large as the run, if it has `least` segments; all segments if `whole`. Returns how many were merged."""
        segments = self.segments()
        rows = sorted((s for s in segments if s.kind == "rows"), key=lambda s: -s.number)
        run: list[Segment] = []
        for s in rows:
            if not whole and run and s.size > ratio * sum(x.size for x in run):
                break
            run.append(s)
        tombs = [s for s in segments if s.kind == "gone"]
        if not run or len(run) < (1 if whole else least) or (len(run) == 1 and not tombs):
            return 0
        older, number = rows[len(run) :], max(s.number for s in segments)
        facts: dict = {}
        for s in run:
            facts |= {k: facts.get(k, 0) + v for k, v in s.facts.items()}
        live = self._live(run, segments).withColumn(NUMBER, F.lit(number).cast("long"))
        parts = max(1, sum(s.size for s in run) // PART_BYTES, -(-sum(s.rows for s in run) // PART_ROWS))
        live = live.repartitionByRange(parts, *self.order).sortWithinPartitions(*self.order) if self.order else live.coalesce(parts)
        kept = [self._put(live, "rows", number, facts=facts)]
        if older and tombs:
            targets = tuple(sorted({t for s in tombs for t in s.targets}))
            kept.append(self._put(self.gone(segments), "gone", number, targets=targets))
        self.commit(older + kept)
        return len(run)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last `keep` versions do not need; returns how many segments went. Not while others read older
        versions or write."""
        there = self.versions()
        needed = {(s.kind, s.name) for v in there[-keep:] for s in self.segments(v)}
        for v in there[:-keep]:
            storage.delete(self.spark, f"{self.path}/manifest/{v:010d}.json")
        loose = [(kind, n) for kind in ("rows", "gone") for n in storage.names(self.spark, f"{self.path}/{kind}") if (kind, n) not in needed]
        for kind, n in loose:
            storage.delete(self.spark, f"{self.path}/{kind}/{n}")
        return len(loose)
