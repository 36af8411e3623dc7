"""Pictures of tiles as a source: written by tasks, scanned with pruned folders, and heights read from their colours."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pictures that a task holds at once, in bytes of pixels.
BATCH_BYTES = 8 << 20
#: PNG's colour types, by channels.
COLOR_TYPES = {1: 0, 3: 2, 4: 6}


def png(pixels: bytes, width: int, channels: int) -> bytes:
    """A PNG of rows of pixels (bytes of 1, 3 or 4 channels)."""
    rows = np.frombuffer(pixels, np.uint8).reshape(-1, width * channels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, COLOR_TYPES[channels], 0, 0, 0)
    plain = np.pad(rows, ((0, 0), (1, 0))).tobytes()  # each row begins with its filter, none
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(plain, 6)) + part(b"IEND", b"")


def encode_heights(grid: Column, encoding: str = "tenths") -> Column:
    """The pixels (bytes red, green, blue of each) whose colours stand for the heights of a grid, to the nearest step;
    heights beyond what the encoding holds take its end. encoding: tenths or fractions."""
    if encoding not in ("tenths", "fractions"):
        raise ValueError(f"no encoding {encoding}")

    @F.pandas_udf("binary")
    def encoded(grids: pd.Series) -> pd.Series:
        def pixels(grid: np.ndarray | None) -> bytes | None:
            if grid is None:
                return None
            h = np.asarray(grid, float)
            steps = np.rint((h + 10000) * 10 if encoding == "tenths" else (h + 32768) * 256)
            return np.clip(steps, 0, (1 << 24) - 1).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()

        return grids.map(pixels)

    return encoded(grid)


def write_pictures(tiles: DataFrame, folder: str, width: int, channels: int = 3) -> DataFrame:
    """tiles (z, x, y, pixels) -> a row for each picture: z, x, y, file, bytes. Writes each tile's pixels as
    folder/z=.../x=.../y.png, the folders that read_pictures() prunes. A file is written beside its place and then moved
    there, so that a task which ends early leaves no half of a picture; a tile that comes twice is written twice, and one
    of the two stays. Tiles without pixels have no picture."""
    from pyarrow import fs

    names = ["z", "x", "y", "file", "bytes"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["pixels"] is None:
                    continue
                home = f"{base}/z={row['z']}/x={row['x']}"
                store.create_dir(home, recursive=True)
                file, data = f"{home}/{row['y']}.png", png(row["pixels"], width, channels)
                aside = f"{home}/.{row['y']}-{attempt}"
                with store.open_output_stream(aside, compression=None) as stream:
                    stream.write(data)
                store.move(aside, file)
                out.append((row["z"], row["x"], row["y"], file, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(),) * 3 + (pa.string(), pa.int64()), strict=True)], names)

    return tiles.select("z", "x", "y", "pixels").mapInArrow(write, "z long, x long, y long, file string, bytes long")


def read_pictures(spark: SparkSession, folder: str, zooms: list[int] | None = None, named: bool = True) -> DataFrame:
    """The pictures of a folder of tiles -> z, x, y, width, height, channels, data (bytes blue, green, red and, of four
    channels, alpha of each pixel, by rows), decoded by the JVM. Files that are no pictures have null data.

    named: folders are z=.../x=..., and conditions on z and x leave the others' files unopened. Else the files are
    z/x/y.png, and only the folders of `zooms` are listed."""
    reader = spark.read.format("image")
    if named:
        found = reader.schema("image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, z int, x int").load(folder)
        if zooms is not None:
            found = found.where(F.col("z").isin(zooms))
        place = [F.col("z"), F.col("x")]
    else:
        found = reader.load([f"{folder.rstrip('/')}/{z}/*/*" for z in (["*"] if zooms is None else zooms)])
        place = [F.regexp_extract("image.origin", rf"(\d+)/(\d+)/\d+\.\w+$", k).cast("int").alias(c) for k, c in ((1, "z"), (2, "x"))]
    y = F.regexp_extract("image.origin", r"(\d+)\.\w+$", 1).cast("int").alias("y")
    valid = F.col("image.nChannels") > 0
    return found.select(*place, y, *[F.when(valid, F.col(f"image.{c}")).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))])


def picture_heights(pictures: DataFrame, encoding: str = "tenths") -> DataFrame:
    """Pictures of read_pictures() -> z, x, y, size, grid: the heights that the colours stand for, by rows. Pictures that
    aren't square, have no colours or couldn't be read are left out."""
    if encoding not in ("tenths", "fractions"):
        raise ValueError(f"no encoding {encoding}")

    @F.pandas_udf("array<double>")
    def heights(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw: bytes, n: int) -> np.ndarray:
            b, g, r = np.frombuffer(raw, np.uint8).reshape(-1, n)[:, :3].astype(float).T
            return (r * 65536 + g * 256 + b) * 0.1 - 10000 if encoding == "tenths" else r * 256 + g + b / 256 - 32768

        return pd.Series([one(raw, n) for raw, n in zip(data, channels, strict=True)])

    square = pictures.where("width = height AND channels >= 3 AND data IS NOT NULL")
    return square.select("z", "x", "y", F.col("width").alias("size"), heights("data", "channels").alias("grid"))


def covering(wanted: DataFrame, pictures: DataFrame, deepest: int) -> DataFrame:
    """wanted (z, x, y, ...) with the picture that covers each tile: of_z, of_x, of_y, the tile itself or its deepest
    ancestor (at most at zoom `deepest`) that has a picture, and the part of it: left, top and share from 0 to 1. Tiles
    that nothing covers have nulls. Only distinct tiles look for ancestors, in one equality join; pictures (z, x, y) are
    read for their places alone."""
    tiles = wanted.select("z", "x", "y").distinct()
    up = tiles.withColumn("of_z", F.explode(F.sequence(F.lit(0), F.least(F.col("z"), F.lit(deepest)))))
    side = F.pow(F.lit(2.0), F.col("z") - F.col("of_z"))
    up = up.withColumns({"of_x": F.floor(F.col("x") / side).cast("long"), "of_y": F.floor(F.col("y") / side).cast("long")})
    there = pictures.select(*[F.col(c).cast("long").alias(f"of_{c}") for c in "zxy"]).distinct()
    best = up.join(there, ["of_z", "of_x", "of_y"]).groupBy("z", "x", "y").agg(F.max_by(F.struct("of_z", "of_x", "of_y"), "of_z").alias("__of"))
    met = wanted.join(best, ["z", "x", "y"], "left").select(*wanted.columns, "__of.*")
    share = F.pow(F.lit(2.0), F.col("of_z") - F.col("z"))
    return met.withColumns({"left": F.col("x") * share - F.col("of_x"), "top": F.col("y") * share - F.col("of_y"), "share": share})
