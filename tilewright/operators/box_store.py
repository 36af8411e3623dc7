"""Boxes in files laid out by place, with a manifest of the files' own boxes that searches are pruned by.

Files are the cells of sort-tile-recursive: strips of equal counts by the centres' x, each cut into rows of equal counts by
their y. Further boxes come as further layouts beside the first and are merged when asked to. A store has one writer at a
time; readers take the last whole manifest.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.spatial import box_join

SIDES = ["minx", "miny", "maxx", "maxy"]
ENTRY = "file string, n long, minx double, miny double, maxx double, maxy double, layout string"


def _meets(west: float, south: float, east: float, north: float) -> Column:
    return (F.col("minx") <= east) & (F.col("maxx") >= west) & (F.col("miny") <= north) & (F.col("maxy") >= south)


def cells(boxes: DataFrame, per_file: int) -> DataFrame:
    """boxes with strip and row: cells of about per_file boxes each. Cuts are quantiles, of all for strips and of each strip
    for its rows; only the cuts of the strips, about the root of the number of files, come to the driver."""
    x, y = (F.col("minx") + F.col("maxx")) / 2.0, (F.col("miny") + F.col("maxy")) / 2.0
    n = boxes.count()
    strips = max(1, math.ceil(math.sqrt(math.ceil(n / per_file))))
    rows = max(1, math.ceil(n / per_file / strips))
    accuracy = max(10_000, 50 * strips)
    shares = lambda parts: [k / parts for k in range(1, parts)]
    cuts = (boxes.agg(F.percentile_approx(x, shares(strips), accuracy)).first()[0] or []) if strips > 1 else []
    after = lambda at, v: F.size(F.filter(at, lambda c: c < v))
    strip = after(F.array(*[F.lit(float(c)) for c in cuts]), x) if cuts else F.lit(0)
    placed = boxes.withColumn("strip", strip.cast("int"))
    if rows == 1:
        return placed.withColumn("row", F.lit(0))
    own = placed.groupBy("strip").agg(F.percentile_approx(y, shares(rows), accuracy).alias("__cuts"))
    return placed.join(F.broadcast(own), "strip").withColumn("row", after(F.col("__cuts"), y).cast("int")).select(*boxes.columns, "strip", "row")  # a row a strip


@dataclass
class BoxStore:
    spark: SparkSession
    folder: str
    per_file: int = 200_000

    def _versions(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found)

    def manifest(self) -> DataFrame:
        """file, n, the box of all its boxes, and the layout that it came with; empty for a store without boxes."""
        known = self._versions()
        if not known:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifest-{known[-1]}")

    def _commit(self, manifest: DataFrame) -> None:
        known = self._versions()
        manifest.coalesce(1).write.parquet(f"{self.folder}/manifest-{known[-1] + 1 if known else 1}")

    def _laid_out(self, boxes: DataFrame) -> DataFrame:
        """Writes boxes as a layout of its own; the manifest's rows for it."""
        layout = uuid.uuid4().hex
        path = f"{self.folder}/layout-{layout}"
        whole = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in SIDES))
        cells(whole, self.per_file).repartition("strip", "row").sortWithinPartitions("strip", "row", "miny").write.partitionBy("strip", "row").parquet(path)
        written = self.spark.read.schema(boxes.schema).parquet(path)
        told = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), *[(F.min if c.startswith("min") else F.max)(c).cast("double").alias(c) for c in SIDES])
        return told.withColumn("layout", F.lit(layout))

    def insert(self, boxes: DataFrame) -> None:
        """Adds boxes (minx, miny, maxx, maxy and other columns, the same ones each time) as a layout beside those that are
        there. Boxes without one of their sides are left out."""
        self._commit(self.manifest().unionByName(self._laid_out(boxes)))

    def files(self, manifest: DataFrame | None = None) -> list[str]:
        return [r["file"] for r in (self.manifest() if manifest is None else manifest).select("file").collect()]

    def _read(self, files: list[str]) -> DataFrame | None:
        return self.spark.read.option("recursiveFileLookup", True).parquet(*files) if files else None

    def all(self) -> DataFrame | None:
        return self._read(self.files())

    def search(self, west: float, south: float, east: float, north: float) -> DataFrame | None:
        """The boxes that have a point in common with one; only files whose own box does are opened (None: there is none)."""
        found = self._read(self.files(self.manifest().where(_meets(west, south, east, north))))
        return found if found is None else found.where(_meets(west, south, east, north))

    def search_many(self, asked: DataFrame, cell: float, key: str = "id") -> DataFrame | None:
        """asked (id, box) -> (a, b): each box asked for with the `key` of the stored ones that it meets. The manifest is
        joined first, so files that no box asks for aren't opened."""
        own = self.manifest().select(F.col("file").alias("id"), *SIDES)
        wide = own.select(F.max(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
        if wide is None:
            return None
        met = box_join(asked.select("id", *SIDES), own, max(cell, wide)).select(F.col("b").alias("file")).distinct()
        found = self._read(self.files(met))
        return found if found is None else box_join(asked.select("id", *SIDES), found.select(F.col(key).alias("id"), *SIDES), cell)

    def remove(self, gone: DataFrame, key: str = "id") -> None:
        """Without the boxes of these keys: the files that hold one are laid out anew without them, the others stay."""
        every = self.all()
        if every is None:
            return
        keys = gone.select(key).distinct()
        touched = every.select(key, F.col("_metadata.file_path").alias("file")).join(keys, key, "left_semi").select("file").distinct()
        hit = self.files(touched)
        if not hit:
            return
        left = self._read(hit).join(keys, key, "left_anti")
        kept = self.manifest().where(~F.col("file").isin(hit))
        self._commit(kept if left.isEmpty() else kept.unionByName(self._laid_out(left)))

    def merge(self) -> None:
        """All layouts as one; older files stay until whoever reads them is done."""
        every = self.all()
        if every is not None:
            self._commit(self._laid_out(every))
