"""Service roads that become ground paint, and those that must stay because they alone connect others.

Roads are edges (road, a, b, length, highway, service, driving, fixed, surface) between nodes; a null node is an end cut off by
the map's edge. ``fixed`` roads never change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graph import components, written

#: Service tags that are always paint, and the length in metres up to which a dead end is a stub. Fixed values.
PAINTED_SERVICE = ("parking_aisle", "driveway", "drive-through")
STUB = 15.0


def _degrees(roads: DataFrame) -> DataFrame:
    """(node, degree) over driving roads; a loop counts twice."""
    ends = roads.where("driving").select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def stub_paths(roads: DataFrame, most: float = STUB) -> DataFrame:
    """(road): roads of dead-end service stubs shorter than ``most``.

    A stub starts at an end where nothing else meets and goes on through nodes where one other service road meets
    and nothing else; it ends at a junction. All stubs walk at once, a road a round, while they are short enough.
    """
    degree = written(_degrees(roads))
    service = written(roads.where("driving AND NOT coalesce(fixed, false) AND highway = 'service'").select("road", "a", "b", "length"))
    at = service.select("road", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("far")), F.struct(F.col("b").alias("node"), F.col("a").alias("far")))).alias("e"), "length")
    arms = written(at.select(F.col("road").alias("arm"), F.col("e.node").alias("_node"), F.col("e.far").alias("far"), F.col("length").alias("more")).where("_node IS NOT NULL"))
    known = degree.select(F.col("node").alias("_n"), "degree")
    dead = at.join(degree.where("degree = 1").select("node"), F.col("e.node") == F.col("node"), "left_semi")
    front = dead.select(F.monotonically_increasing_id().alias("walk"), F.array("road").alias("path"), F.col("e.far").alias("at"), "length")
    done = []
    while True:
        here = written(front.join(known, F.col("at") == F.col("_n"), "left").drop("_n").where((F.col("length") < most) & F.col("at").isNotNull()))
        done.append(here.where("degree <> 2").select(F.explode("path").alias("road")))
        near = here.where("degree = 2").drop("degree").join(arms, F.col("at") == F.col("_node")).where(~F.array_contains("path", F.col("arm")))
        # with two arms there is one way on at most; a loop's two ends are one arm
        front = written(near.groupBy("walk").agg(F.count_distinct("arm").alias("n"), F.min(F.struct("arm", "far", "more", "path", "length")).alias("s")).where("n = 1").select("walk", F.concat("s.path", F.array("s.arm")).alias("path"), F.col("s.far").alias("at"), (F.col("s.length") + F.col("s.more")).alias("length")))
        if front.isEmpty():
            return reduce(DataFrame.union, done).distinct()


def connecting(roads: DataFrame, painted: DataFrame) -> DataFrame:
    """(road): painted roads that lie between different parts of what is left, so they stay roads.

    What is left falls into connected parts. Painted roads between these are pruned at their dead ends, round by round; a connected
    group of what remains that touches two parts or more is restored.
    """
    chosen = painted.select(F.col("road").alias("_p")).distinct()
    flagged = written(roads.select("road", "a", "b").join(chosen, F.col("road") == F.col("_p"), "left").select("road", "a", "b", F.col("_p").isNotNull().alias("painted")))
    # nothing else meets at a cut end, so a road that stays is a loop at its other end
    left = flagged.where("NOT painted").select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))
    part = written(components(left))
    known = part.select(F.col("node").alias("_n"), F.concat(F.lit("part "), F.col("component").cast("string")).alias("_part"))
    edges = flagged.where("painted").drop("painted")
    for c, end in (("a", "x"), ("b", "y")):
        name = F.coalesce("_part", F.concat(F.lit("n"), F.col(c).cast("string")), F.concat(F.lit(end), F.col("road").cast("string")))
        edges = edges.join(known, F.col(c) == F.col("_n"), "left").withColumn(c, name).drop("_n", "_part")
    edges = written(edges)
    while True:
        ends = edges.select("road", F.explode(F.array("a", "b")).alias("node")).where("NOT startswith(node, 'part ')")
        lone = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("road").alias("_lone")).where("n = 1").select("_lone").distinct()
        lone = written(lone)
        if lone.isEmpty():
            break
        edges = written(edges.join(lone, F.col("road") == F.col("_lone"), "left_anti"))
    group = written(components(edges.select("a", "b")))
    parts = group.where("startswith(node, 'part ')").groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component").alias("_g"))
    tied = group.join(parts, F.col("component") == F.col("_g"), "left_semi").select(F.col("node").alias("_t"))
    return edges.join(tied, F.col("a") == F.col("_t"), "left_semi").select("road")


def paint_service(roads: DataFrame) -> DataFrame:
    """(road, kind, surface): roads that become ground paint: service roads of the named kinds, dead-end stubs and tracks, without those that alone connect others.

    roads have also ``structural``: roads off the ground, which connect but are never painted. The surface is the road's own, else dirt for tracks and asphalt for others.
    """
    roads = written(roads)  # each step reads them again
    free = "driving AND NOT coalesce(fixed, false)"
    always = roads.where(f"{free} AND ((highway = 'service' AND service IN ({', '.join(map(repr, PAINTED_SERVICE))}) AND NOT (a IS NULL AND b IS NULL)) OR highway = 'track')").select("road")
    painted = written(always.union(stub_paths(roads)).distinct())
    stays = connecting(roads.where("driving OR structural"), painted).withColumnRenamed("road", "_stays")
    gone = painted.join(stays, F.col("road") == F.col("_stays"), "left_anti").withColumnRenamed("road", "_p")
    final = roads.join(gone, F.col("road") == F.col("_p"), "left_semi")
    return final.select("road", F.col("highway").alias("kind"), F.coalesce("surface", F.when(F.col("highway") == "track", "dirt").otherwise("asphalt")).alias("surface"))
