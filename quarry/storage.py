"""Tables between steps: written into the folder that the cluster shares, so that a lost executor repeats no finished step."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, local sessions get a temporary one; a cluster is refused,
    as its machines do not see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        at = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    """The file system and the path, as the cluster sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not be there yet: whole under another name first, then renamed."""
    fs, at = _files(spark, path)
    _, part = _files(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise FileExistsError(path)


def size_of(spark: SparkSession, path: str) -> int:
    fs, at = _files(spark, path)
    return int(fs.getContentSummary(at).getLength())


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


#: Spark's setting (4.1 and later) that the shuffle files of an execution go when it ends, not when the driver's memory is next
#: collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITES: dict[SparkSession, list] = {}  # how many writes are under way in a session, and its setting before the first


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """A write has a plan of its own, which nothing else executes, so nothing reads its shuffle files later. The session has its
    own setting back after its last write under way."""
    with _LOCK:
        state = _WRITES.setdefault(spark, [0, spark.conf.get(CLEANUP, None)])
        state[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            state[0] -= 1
            if not state[0]:
                del _WRITES[spark]
                if state[1] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, state[1])


_WRITTEN: list[str] = []
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)  # what is written inside settled()


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: computed once, its lineage cut. by: columns whose values
    get folders of their own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    _WRITTEN.append(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written(make(), name), then deletes the tables that were written on the way, so make() hands none of them on."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = written(make(), name)
    finally:
        _MADE.reset(token)
        if (outer := _MADE.get()) is not None:
            outer.extend(made)
    for path in made[:-1]:
        delete(out.sparkSession, path)
        for held in (_WRITTEN, outer):
            if held and path in held:
                held.remove(path)
    return out


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that this program has written, when the results that read them are no longer needed."""
    n = len(_WRITTEN)
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
    return n
