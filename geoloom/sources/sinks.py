"""Publishing results: all or nothing, with a manifest; coverage checks before a job starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Writes to a new place (an existing one refuses) and then its manifest, last: (rows). Without it the place is not published."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    spark = df.sparkSession
    manifest = spark.read.parquet(f"{path}/data").agg(F.count(F.lit(1)).alias("rows"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def write_layer(records: DataFrame, path: str) -> DataFrame:
    """Records (field, id, …, x0, y0, x1, y1, basis) by field; returns per field the count, extent and estimated rows of what was published."""
    publish(records, path, "field")
    published = records.sparkSession.read.schema(records.schema).parquet(f"{path}/data")
    return published.groupBy("field").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.count_if(F.col("basis") != "source").alias("estimated"))


def tiles_for(boxes: DataFrame, margin: float) -> DataFrame:
    """(id, tile_x, tile_y): the one-degree tiles that boxes (id, west, south, east, north) need with a margin."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) - margin), F.ceil(F.col(b) + margin) - 1))
    return boxes.withColumn("tile_x", span("west", "east")).withColumn("tile_y", span("south", "north")).select("id", "tile_x", "tile_y")


def preflight(needed: DataFrame, present: DataFrame, absent: DataFrame) -> DataFrame:
    """(tile_x, tile_y, verdict) of needed tiles: present, absent (known not to exist) or missing."""
    keys = ["tile_x", "tile_y"]
    there = present.select(*keys).distinct().withColumn("_there", F.lit(True))
    none = absent.select(*keys).distinct().withColumn("_none", F.lit(True))
    both = needed.select(*keys).distinct().join(there, keys, "left").join(none, keys, "left")
    return both.select(*keys, F.when(F.col("_there"), "present").when(F.col("_none"), "absent").otherwise("missing").alias("verdict"))
