"""Tables written to the folder that all executors share, to cut lineage between steps."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Folders of this process that are deleted when its JVM ends.
_MADE: set[str] = set()
#: Folders given out, in order.
_GIVEN: list[str] = []


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tilewright-")


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local master without it gets a temporary folder; a cluster must set it."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder for intermediate tables, under one of the application's own that goes when the JVM ends."""
    home = f"{shared_root(spark)}/tilewright/{spark.sparkContext.applicationId}"
    if home not in _MADE:
        files, at = _files(spark, home)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _MADE.add(home)
    _GIVEN.append(f"{home}/{label}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps never recompute what is before it.
    by: a last column that parts the files, so that reading one of its values reads its files alone."""
    path = new_folder(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make() as a stored table; the tables that it stored on the way are deleted."""
    first = len(_GIVEN)
    done = stored(make(), label)
    for path in _GIVEN[first:-1]:
        files, at = _files(done.sparkSession, path)
        files.delete(at, True)
    del _GIVEN[first:-1]
    return done


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that stored() returned and nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        files, at = _files(df.sparkSession, path)
        if any(path.startswith(home) for home in _MADE):
            files.delete(at, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keeps the Arrow batches of whole texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
