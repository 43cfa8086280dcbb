"""Tables between steps, in the folder that the cluster shares, and tables that are published as versions."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of narrow rows up to which they are broadcast, and what a row counts as.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 48
#: Folders of the tables that each open ``passing`` block has settled.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and Spark runs in one process a local folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: ends the lineage, and is computed once however often it is used."""
    path = shared_path(df.sparkSession, name)
    if blocks := _PASSING.get():
        blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are settled within the block go at its end. What the block gives settles what has to last beyond it, up to the end of the block around it, if there is one."""
    outer, paths = _PASSING.get(), []

    def lasting(df: DataFrame, name: str) -> DataFrame:
        inside = _PASSING.set(outer)
        try:
            return settled(df, name)
        finally:
            _PASSING.reset(inside)

    token = _PASSING.set((*outer, paths))
    try:
        yield lasting
    finally:
        _PASSING.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in paths:
            at = hadoop.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of finished jobs: it does so once the driver has collected their handles."""
    gc.collect()
    spark._jvm.System.gc()


def few(rows: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Narrow settled rows, to be broadcast if they are few: what joins them is then not shuffled."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


@dataclass
class Version:
    """What a version's marker says: its number, its folder, the last batch of each stream that it holds, and what the commit that made it counted."""

    number: int = 0
    folder: str = ""
    batches: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


class Versions:
    """A table as a row of versions. A version is a folder of its own, written whole by Spark's commit; it counts once its numbered marker is there.

    A marker is written aside and then moved to its number, which succeeds for one writer only, so no number is taken twice and none is ever seen half-made: on a local or mounted file
    system by a hard link, elsewhere by renaming a file to a name that must be free, as HDFS does in one step. Stores whose rename overwrites can't hold such tables.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}"
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(f"{self.root}/current")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)

    def numbers(self) -> list[int]:
        return sorted(int(n) for s in self._fs.listStatus(self._at) if (n := s.getPath().getName()).isdigit())

    def read(self, number: int) -> Version | None:
        """The version of a number; none if its marker can't be read, as one that another tool left half-made."""
        stream = self._fs.open(self._hadoop.Path(self._at, str(number)))
        try:
            return Version(number, **json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> Version:
        """The version with the largest number that can be read; number 0 if there is none."""
        return next((v for n in reversed(self.numbers()) if (v := self.read(n))), Version())

    def table(self, version: Version) -> DataFrame | None:
        return self.spark.read.parquet(version.folder) if version.folder else None

    def written(self, df: DataFrame) -> str:
        folder = f"{self.root}/versions/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def claim(self, version: Version) -> bool:
        """Make it the version of its number; False if that number is taken."""
        aside = self._hadoop.Path(self._at, f".{uuid.uuid4().hex}")
        said = {"folder": version.folder, "batches": version.batches, "counts": version.counts}
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        to = self._hadoop.Path(self._at, str(version.number))
        try:
            if self._fs.getUri().getScheme() != "file":
                return self._fs.rename(aside, to)
            paths = [self.spark._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)) for p in (to, aside)]
            self.spark._jvm.java.nio.file.Files.createLink(*paths)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(aside, False)


def published(df: DataFrame, root: str, name: str) -> str:
    """Write a new version of a table and make it the current one; returns its folder. Readers see the old version or the new one, never a part. Of writers that race each gets a number of its own."""
    versions = Versions(df.sparkSession, root, name)
    version = Version(folder=versions.written(df))
    while True:
        version.number = max(versions.numbers(), default=0) + 1
        if versions.claim(version):
            return version.folder


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that was published last."""
    versions = Versions(spark, root, name)
    return versions.table(versions.latest())


def committed(spark: SparkSession, root: str, name: str, change: Callable[[DataFrame | None], tuple[DataFrame, dict[str, int]]], stream: str, batch: int) -> Version:
    """Apply a batch of a stream to the current version, once: a batch that a version already holds changes nothing.

    ``change`` gets the current table (None at first) and returns the new one and what it counted. If another writer publishes meanwhile the change is made anew on what it left, so none is lost.
    What a killed writer wrote without a marker is seen by nobody.
    """
    versions = Versions(spark, root, name)
    while True:
        now = versions.latest()
        if batch <= now.batches.get(stream, -1):
            return now
        table, counts = change(versions.table(now))
        new = Version(0, versions.written(table), now.batches | {stream: batch}, counts)
        new.number = max(versions.numbers(), default=0) + 1
        if versions.latest().number == now.number and versions.claim(new):  # nobody has published meanwhile, and nobody can before this
            return new


def write_json(df: DataFrame, path: str) -> str:
    """JSON artifacts, a line a record, every task its own file."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
