"""Tables written to the folder that all executors share, to cut lineage between the rounds of iterative operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HOMES: set[str] = set()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tilewright-")


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _home(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which goes when its JVM ends; only a local master may
    leave that setting unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_folder()
    home = f"{root.rstrip('/')}/tilewright/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        files, at = _files(spark, home)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _HOMES.add(home)
    return home


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a folder of this application in the shared folder."""
    return f"{_home(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def done_with(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and nothing reads any more."""
    for df in tables:
        files, at = _files(df.sparkSession, df.written_at)
        files.delete(at, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as the session shuffles to, by the keys' hashes or evenly: for work whose rows are small and
    dear. Such tables are a few MB, which one task would read, and into which adaptive plans would merge a plain shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
