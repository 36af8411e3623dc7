"""Feature views over the test tables, none of which has coordinates of its own: each derives them from its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_points(df: DataFrame, key: str) -> DataFrame:
    """Points on an even lattice."""
    k = F.col(key).cast("long")
    return df.withColumns({"lng": (k * 7919 % 360000) / F.lit(1000.0) - 180, "lat": (k * 104729 % 170000) / F.lit(1000.0) - 85})


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as point features with properties event_type, value, user_id and k."""
    events = table(spark, sf_dir, "events")
    return with_points(events.withColumn("k", F.get_json_object("props", "$.k").cast("double")), "event_id")


def event_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points in clumps around their users."""
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").withColumns(
        {"lng": (u * 37 % 36) * 10 - 175 + (e % 97) / F.lit(97.0), "lat": (u * 13 % 16) * 10 - 75 + (e % 89) / F.lit(89.0)}
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polyline for each order in tile units: id, vertices (array of x, y)."""
    vertex = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 7919 % 4096).cast("double").alias("x"), ((F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 37) % 4096).cast("double").alias("y"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(vertex)).alias("v"))
    return items.select(F.col("l_orderkey").alias("id"), F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("vertices"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned boxes: id, minx, miny, maxx, maxy."""
    x, y = F.col("p_partkey") * 7919 % 4096, F.col("p_partkey") * 104729 % 4096
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", x.alias("minx"), y.alias("miny"), (x + F.col("p_size")).alias("maxx"), (y + F.col("p_size") * 2).alias("maxy"))


# The same views in SQL.
EV = "SELECT *, ((event_id*7919)%360000)/1000e0-180 AS lng, ((event_id*104729)%170000)/1000e0-85 AS lat, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k FROM events"
CLUMP = "SELECT *, ((user_id*37)%36)*10-175+(event_id%97)/97e0 AS lng, ((user_id*13)%16)*10-75+(event_id%89)/89e0 AS lat FROM events"
LINES = "SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, CAST((l_partkey*7919)%4096 AS DOUBLE) AS x, CAST((l_suppkey*104729+l_linenumber*37)%4096 AS DOUBLE) AS y FROM lineitem"
BOXES = "SELECT p_partkey AS id, p_brand, (p_partkey*7919)%4096 AS minx, (p_partkey*104729)%4096 AS miny, (p_partkey*7919)%4096+p_size AS maxx, (p_partkey*104729)%4096+p_size*2 AS maxy FROM part"
