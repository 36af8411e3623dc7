"""Token counts as delta-maintained rollups.

A rollup is a folder of signed rows. Each committed batch has a table `documents` of what it changed of the count of each
document, parted by buckets of the identifier's hash, and a table `totals` of the same summed by source, language and
tokenizer version. Totals are additive: the sum of all batches is the state, and folding old batches into one changes
nothing. A batch reads the earlier rows of the buckets that its own documents fall into, and no others.

A batch is written to a folder of its own and counts from when a log file with the batch's number is made, which names
that folder. The file is made only if it isn't there, so of two commits of a batch, repeated or racing, one is applied.
Batches that change the same documents are to be committed one after the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.scratch import stored

GROUP = ["source", "lang", "version"]
STATE = "id {kind}, source string, lang string, version string, documents long, tokens long, bucket int"
TOTALS = "source string, lang string, version string, documents long, tokens long"


@dataclass
class TokenRollup:
    """The rollup in `folder`, on storage that all executors share. kind: the type of document identifiers; buckets: how
    finely documents are parted, the same in all commits."""

    spark: SparkSession
    folder: str
    kind: str = "bigint"
    buckets: int = 64

    def _path(self, name: str = "") -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _files(self) -> object:
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> dict[str, str]:
        """The log's files and the folders that they name; a file that its maker didn't come to fill names none."""
        files, home = self._files(), self._path("log")
        names = sorted(x.getPath().getName() for x in files.listStatus(home)) if files.exists(home) else []
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        out = {}
        for name in names:
            stream = files.open(self._path(f"log/{name}"))
            out[name] = read(stream, "UTF-8")
            stream.close()
        return out

    def _claim(self, name: str, data: str) -> bool:
        """Makes the log file unless it is there."""
        try:
            out = self._files().create(self._path(f"log/{name}"), False)
        except Py4JJavaError:
            if self._files().exists(self._path(f"log/{name}")):
                return False
            raise
        out.write(bytearray(data.encode()))
        out.close()
        return True

    def folded(self) -> int:
        """The number up to which batches are folded into one, -1 if none is."""
        return max((int(x[5:]) for x, data in self._log().items() if x.startswith("base-") and data), default=-1)

    def parts(self) -> list[str]:
        """The log's files whose sum is the state: the newest base and the batches after it."""
        base, log = self.folded(), self._log()
        return [f"base-{base:012d}"] * (base >= 0) + [x for x, data in log.items() if x.startswith("batch-") and data and int(x[6:]) > base]

    def _read(self, table: str, schema: str) -> DataFrame:
        log = self._log()
        found = [f"{self.folder}/data/{log[x]}/{table}" for x in self.parts()]
        frames = [self.spark.read.schema(schema).parquet(x) for x in found]  # each with buckets of its own
        whole = self.spark.createDataFrame([], schema)
        for one in frames:
            whole = whole.unionByName(one)
        return whole

    def _bucket(self, id_column: Column) -> Column:
        return F.pmod(F.xxhash64(id_column), F.lit(self.buckets)).cast("int")

    def _put(self, name: str, rows: DataFrame) -> bool:
        """Writes signed rows and their totals, and makes them part of the state by the log file `name`."""
        data = f"{name}-{uuid.uuid4().hex}"
        summed = rows.groupBy("id", *GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")
        summed.withColumn("bucket", self._bucket(F.col("id"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{data}/documents")
        written = self.spark.read.schema(STATE.format(kind=self.kind)).parquet(f"{self.folder}/data/{data}/documents")
        written.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/data/{data}/totals")
        if self._claim(name, data):
            return True
        self._files().delete(self._path(f"data/{data}"), True)
        return False

    def fold(self) -> None:
        """Folds all committed batches into one base; totals stay as they are. A batch whose number is not above the
        base's counts as applied."""
        parts, log = self.parts(), self._log()
        if len(parts) > 1 and self._put(f"base-{int(parts[-1].split('-')[1]):012d}", self._read("documents", STATE.format(kind=self.kind)).drop("bucket")):
            for x in parts:
                self._files().delete(self._path(f"log/{x}"), True)
                self._files().delete(self._path(f"data/{log[x]}"), True)

    def documents(self, buckets: list[int] | None = None) -> DataFrame:
        """The documents that count now, of all buckets or of some: id, source, lang, version, tokens."""
        rows = self._read("documents", STATE.format(kind=self.kind))
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        state = rows.groupBy("id", *GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return state.where("documents <> 0").drop("documents")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens of all groups that have documents."""
        sums = self._read("totals", TOTALS).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch of changes (op, id, source, lang, version, tokens); False if it was applied before.

        op is insert, revise or delete. An insert or revision sets the document's source, language and count under a
        tokenizer version, whatever they were; a delete takes the document away under that version. Of several changes
        of one document and version in a batch the one with the greatest `seq` holds where changes have that column,
        else the greatest of (op, source, lang, tokens). Changes without an identifier count as changes of one unnamed
        document; null sources, languages and versions are groups of their own; null tokens count as 0. Deleting what
        is not there changes nothing.
        """
        name = f"batch-{batch:012d}"
        if batch <= self.folded() or self._log().get(name):
            return False
        if name in self._log():  # made by a commit that came to no end
            self._files().delete(self._path(f"log/{name}"), True)
        order = F.struct(F.col("seq") if "seq" in changes.columns else F.lit(0).alias("seq"), "op", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))
        last = stored(changes.groupBy("id", "version").agg(F.max(order).alias("c")).select("id", "version", "c.*"), "changes")
        touched = [r[0] for r in last.select(self._bucket(F.col("id"))).distinct().collect()]  # at most `buckets` rows
        now = self.documents(touched)
        key = now["id"].eqNullSafe(last["id"]) & now["version"].eqNullSafe(last["version"])
        old = now.join(last.select("id", "version"), key, "left_semi").select("id", *GROUP, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))
        new = last.where("op <> 'delete'").select("id", *GROUP, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))
        return self._put(name, old.union(new))
