"""Road semantics: dimensions, shared crossings, structures, junction arms, ends, ramps and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import seeded
from geoloom.functions.rules import LANE_MARGIN, LANE_METRES, MOST_LANES
from geoloom.operators.graph import components, written

WIDEST_LANE = 4.5


def dimensions(width: Column, lanes: Column, shoulder: Column, default_lanes: Column) -> tuple[Column, Column, Column, Column]:
    """(width, lanes, lane width, basis) in metres: a tagged width stays; lanes wider than 4.5 m are counted anew from it."""
    shoulder = F.coalesce(shoulder, F.lit(0.0))
    room = F.greatest(F.lit(0.2), width - shoulder)
    by_width = width.isNotNull() & (lanes.isNull() | (room / lanes > WIDEST_LANE))
    estimate = F.greatest(F.coalesce(lanes, F.lit(1)), F.bround(room / LANE_METRES).cast("int"))
    count = F.when(by_width, F.least(estimate, F.lit(MOST_LANES))).otherwise(F.coalesce(lanes, default_lanes))
    basis = F.when(by_width, "width").when(lanes.isNotNull(), "lanes").otherwise("class")
    full = F.coalesce(width, count * LANE_METRES + LANE_MARGIN + shoulder)
    free = F.when(width.isNotNull(), F.greatest(F.lit(0.2), width - shoulder - LANE_MARGIN)).otherwise(count * LANE_METRES)
    return full, count, F.least(F.lit(WIDEST_LANE), free / count), basis


def fitted_lanes(roads: DataFrame, gaps: DataFrame, clearance: float) -> DataFrame:
    """(id, lanes, fitted): roads without tagged lanes keep only what fits twice the gap (id, distance) to the nearest building."""
    near = gaps.groupBy("id").agg(F.min("distance").alias("_near")).withColumnRenamed("id", "_id")
    both = roads.join(near, F.col("id") == F.col("_id"), "left")
    room = F.greatest(F.lit(0.0), 2 * (F.col("_near") - clearance))
    fit = F.greatest(F.lit(1), F.least(F.col("lanes"), F.floor((room - LANE_MARGIN) / LANE_METRES).cast("int")))
    return both.select("id", "lanes", F.when(F.col("tagged") | F.col("_near").isNull(), F.col("lanes")).otherwise(fit).alias("fitted"))


def unshared(crossings: DataFrame, incidence: DataFrame) -> DataFrame:
    """Crossings (a_id, b_id, …) of ways that have no node in common (incidence: id, ref)."""
    crossings = written(crossings)  # found once, not again for what it is compared with
    pairs = crossings.select("a_id", "b_id").distinct()
    a = incidence.select(F.col("id").alias("_ia"), F.col("ref").alias("_ra")).distinct()
    b = incidence.select(F.col("id").alias("_ib"), F.col("ref").alias("_rb")).distinct()
    shared = pairs.join(a, F.col("a_id") == F.col("_ia")).join(b, (F.col("b_id") == F.col("_ib")) & (F.col("_ra") == F.col("_rb")))
    shared = shared.select(F.col("a_id").alias("_a"), F.col("b_id").alias("_b")).distinct()
    return crossings.join(shared, (F.col("a_id") == F.col("_a")) & (F.col("b_id") == F.col("_b")), "left_anti")


def vertical_faults(ways: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, fault) of ways (id, kind) whose vertices (id, ele) have heights in part, or, on a bridge or tunnel, none, or one beyond 10,000."""
    n = vertices.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("ele").alias("e"), F.max(F.abs("ele")).alias("top")).withColumnRenamed("id", "_id")
    both = ways.join(n, F.col("id") == F.col("_id"))
    fault = F.when((F.col("e") > 0) & (F.col("e") < F.col("n")), "partial").when((F.col("kind") != "ground") & (F.col("e") == 0), "no heights").when(F.col("top") > 10_000, "range")
    return both.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def grounded_components(edges: DataFrame, ground: DataFrame, least: int = 2) -> DataFrame:
    """(component, grounded): structure components (edges a, b) that rest on at least ``least`` ground nodes."""
    hit = components(edges).join(ground.select(F.col("node").alias("_g")).distinct(), F.col("node") == F.col("_g"))
    return hit.groupBy("component").agg(F.count(F.lit(1)).alias("grounded")).where(F.col("grounded") >= least)


def junction_arms(arms: DataFrame, most: int = 32) -> DataFrame:
    """(node, n, ways, fault): the arms (node, way, clearance) of each node; too many or disagreeing clearances are faults.

    Only nodes within the limit list their ways, so no list outgrows it.
    """
    n = arms.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("clearance").alias("lo"), F.max("clearance").alias("hi"))
    fit = n.where(F.col("n") <= most).select(F.col("node").alias("_n"))
    listed = arms.join(fit, F.col("node") == F.col("_n"), "left_semi").groupBy(F.col("node").alias("_n")).agg(F.array_sort(F.collect_list("way")).alias("ways"))
    fault = F.when(F.col("n") > most, "too many").when(F.col("lo") != F.col("hi"), "clearance")
    return n.join(listed, F.col("node") == F.col("_n"), "left").select("node", "n", "ways", fault.alias("fault"))


def end_clearances(ends: DataFrame, dead_end: float, joined: float) -> DataFrame:
    """(id, end, clear) of road ends (id, end, node): a dead end keeps one clearance, an end that meets others another."""
    d = ends.groupBy("node").agg(F.count(F.lit(1)).alias("_d")).withColumnRenamed("node", "_node")
    return ends.join(d, F.col("node") == F.col("_node")).select("id", "end", F.when(F.col("_d") == 1, dead_end).otherwise(joined).alias("clear"))


def ramp_profile(arcs: DataFrame, height: float, grade: float) -> DataFrame:
    """(id, seq, z): heights at the vertices of chains given as arc_length() rows, rising from both ends at a grade to a height."""
    z = F.least(F.lit(height), F.col("at") * grade, (F.col("total") - F.col("at")) * grade)
    return arcs.select("id", "seq", z.alias("z"))


def straightest_pair(arms: DataFrame) -> DataFrame:
    """(node, a, b): of each node's arms (node, way, dx, dy as unit vectors) the two that run most straight on; ties to the smaller ways.

    Arms of a node are few (see junction_arms), so pairs within a node stay bounded.
    """
    o = arms.select(F.col("node").alias("_n"), F.col("way").alias("b"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    pairs = arms.withColumnRenamed("way", "a").join(o, (F.col("node") == F.col("_n")) & (F.col("a") < F.col("b")))
    dot = F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")
    return pairs.groupBy("node").agg(F.min(F.struct(dot.alias("dot"), "a", "b")).alias("m")).select("node", "m.a", "m.b")


def source_heights(height: Column, levels: Column, level: float = 3.0, low: float = 2.6) -> tuple[Column, Column]:
    """(metres, basis): a tagged height, unless it is under 2.6 m a level; else the levels; else null."""
    fine = height.isNotNull() & (levels.isNull() | (height >= low * levels))
    return F.when(fine, height).otherwise(levels * level), F.when(fine, "height").when(levels.isNotNull(), "levels")


def seeded_storeys(key: Column, low: Column, high: Column, level: float = 3.0) -> Column:
    """A height of low to high storeys that depends on the key alone (spans up to 64 storeys)."""
    return (low + F.pmod(seeded(1 << 62, F.lit("storeys"), key), high - low + 1)) * level


def regroup(parts: DataFrame, group: str, key: str, prefix: str) -> DataFrame:
    """Parts of a record split by a new key: the group's smallest key keeps the record's id, others get one from both."""
    first = F.col(key) == F.min(key).over(Window.partitionBy(group))
    fresh = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", F.col(group).cast("string"), F.col(key).cast("string")), 256), 1, 12))
    return parts.withColumn("record", F.when(first, F.col(group).cast("string")).otherwise(fresh))
