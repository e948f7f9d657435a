"""Lines that run beside each other: opposite carriageways, sidewalks, and footways that sidewalks already hold.

Lines are segment rows (id, seq, x, y, x2, y2). They are compared at samples of a fixed spacing along
them, each with the segments of the other side within reach, by the grid join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import point_segment_distance2
from geoloom.operators.graph import written
from geoloom.operators.sequences import arc_length
from geoloom.operators.spatial import box_join, boxed_segments, once

PARALLEL = 0.9


def _headed(segs: DataFrame) -> DataFrame:
    dx, dy = (F.col("x2") - F.col("x")).cast("double"), (F.col("y2") - F.col("y")).cast("double")
    size = F.sqrt(dx * dx + dy * dy)
    return segs.where(size > 0).withColumns({"hx": dx / size, "hy": dy / size})


def _places(at: Column, size: Column, spacing: float) -> tuple[Column, Column]:
    """First and last multiple of the spacing on a piece of a line; none if the last is smaller."""
    return F.ceil(at / spacing), F.ceil((at + size) / spacing) - 1


def _dot() -> Column:
    return F.col("a_hx") * F.col("b_hx") + F.col("a_hy") * F.col("b_hy")


def with_places(lines: DataFrame, spacing: float) -> DataFrame:
    """Segments (…, hx, hy, len, at, total, n, first, last) with the samples first to last of the line's ``n`` on them; those without a sample go."""
    own = _headed(arc_length(lines).where("len > 0"))
    first, last = _places(F.col("at"), F.col("len"), spacing)
    return own.withColumns({"n": F.ceil(F.col("total") / spacing), "first": first, "last": last}).where("first <= last").drop("seq", "fraction")


def beside(pairs: DataFrame, along: list[Column], spacing: float, reach: int = 0) -> DataFrame:
    """Pairs (a_ columns of ``with_places``) once for each sample a_k on a, at _p (x, y), whose place along the line is within reach of the places from the least to the greatest of ``along``."""
    # one unit more is for rounding
    low, high = F.ceil((F.least(*along) + F.col("a_at") - (reach + 1)) / spacing), F.floor((F.greatest(*along) + F.col("a_at") + (reach + 1)) / spacing)
    each = once(pairs, _k=F.struct(F.greatest("a_first", low).alias("low"), F.least("a_last", high).alias("high"))).where("_k.low <= _k.high")
    each = each.withColumn("a_k", F.explode(F.sequence("_k.low", "_k.high")))
    t = (F.col("a_k") * spacing - F.col("a_at")) / F.col("a_len")
    return once(each, _p=F.struct(*[(F.col(f"a_{c}") + t * (F.col(f"a_{c}2") - F.col(f"a_{c}"))).alias(c) for c in "xy"])).drop("_k")


def ahead(x: Column, y: Column) -> Column:
    """How far a place lies along segment a from its start."""
    return (x - F.col("a_x")) * F.col("a_hx") + (y - F.col("a_y")) * F.col("a_hy")


def _met(lines: DataFrame, segs: DataFrame, spacing: float, reach: int, same: tuple[str, str] | None = None) -> DataFrame:
    """Segments a of lines, with the samples first to last of ``n`` on them, and the segments b within reach of them along both axes."""
    own = with_places(lines, spacing)
    pairs = box_join(boxed_segments(own), boxed_segments(_headed(segs)), max(1, 2 * reach), reach, same)
    return pairs.drop("a_total", *[f"{p}_{c}{n}" for p in "ab" for c in "xy" for n in "01"])


def _sampled(pairs: DataFrame, spacing: float, reach: int) -> DataFrame:
    """Samples a (a_k, a_x, a_y) of pairs of segments (as ``_met`` gives them) with ``gap``, how far segment b is from them, up to reach."""
    # a sample within reach of a point of b is within reach of its place along a, too
    each = beside(pairs, [ahead(F.col(f"b_x{e}"), F.col(f"b_y{e}")) for e in ("", "2")], spacing, reach)
    gap = F.sqrt(point_segment_distance2(F.col("_p.x"), F.col("_p.y"), *[F.col(f"b_{c}") for c in ("x", "y", "x2", "y2")]))
    each = once(each, gap=gap).where(F.col("gap") <= reach)
    return each.withColumns({"a_x": F.col("_p.x"), "a_y": F.col("_p.y")}).drop("_p", "a_x2", "a_y2", "a_at", "a_len", "a_first", "a_last")


def match_carriageways(roads: DataFrame, spacing: float, least: float, most: int) -> DataFrame:
    """(id, k, partner, gap): for each sample of a road the nearest other road of its ``kind`` that runs the other way, least to most away; ties go to the smaller id."""
    # segments meet first, once for all of their samples; a sample is made for a segment that may be its partner
    line = ["id", "kind", "x", "y", "x2", "y2"]
    pairs = _met(roads.select(*line, "seq"), roads.select(line), spacing, most, ("kind", "kind"))
    pairs = pairs.where((F.col("a_id") != F.col("b_id")) & (_dot() < -PARALLEL)).drop("a_kind", "b_kind", "b_hx", "b_hy", "a_n")
    # dealt by road before samples are made, so these need no shuffle of their own; in a fixed number of parts, as adaptive execution would pack them by the bytes of pairs
    parts = int(roads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = _sampled(pairs.repartition(parts, "a_id"), spacing, most)
    best = each.where(F.col("gap") >= least).groupBy(F.col("a_id").alias("id"), F.col("a_k").alias("k")).agg(F.min(F.struct("gap", F.col("b_id").alias("partner"))).alias("m"))
    return best.select("id", "k", "m.partner", "m.gap")


def match_sidewalks(roads: DataFrame, footways: DataFrame, spacing: float, reach: int, widest: int) -> tuple[DataFrame, DataFrame]:
    """(id, side, offset) and (road, footway): sides of roads (…, width) along which parallel footways (…, width) run, and what runs there.

    A footway counts at a sample if its middle is at most ``reach`` from the road's edge; a side counts with
    half of the road's samples. The offset is the upper median of the footways' outer edges from the road's edge.
    Side 1 is left. No road may be wider than ``widest``.
    """
    far = reach + (widest + 1) // 2
    near = _sampled(written(_met(roads, footways, spacing, far).where(F.abs(_dot()) >= PARALLEL).drop("b_seq", "b_hx", "b_hy")), spacing, far)
    near = near.where(F.col("gap") - F.col("a_width") / 2.0 <= reach)
    dx, dy = F.col("b_x2") - F.col("b_x"), F.col("b_y2") - F.col("b_y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("a_x") - F.col("b_x")) * dx + (F.col("a_y") - F.col("b_y")) * dy) / (dx * dx + dy * dy).cast("double")))
    ox, oy = F.col("b_x") + t * dx - F.col("a_x"), F.col("b_y") + t * dy - F.col("a_y")
    side = F.when(oy * F.col("a_hx") - ox * F.col("a_hy") >= 0, 1).otherwise(-1)
    seen = written(near.select(F.col("a_id").alias("id"), F.col("a_k").alias("k"), F.col("a_n").alias("n"), side.alias("side"), F.col("b_id").alias("footway"), (F.col("gap") + F.col("b_width") / 2.0 - F.col("a_width") / 2.0).alias("outer")))
    each = seen.groupBy("id", "side", "n", "k").agg(F.min("outer").alias("outer"))
    sides = each.groupBy("id", "side", "n").agg(F.array_sort(F.collect_list("outer")).alias("o")).where(F.size("o") * 2 >= F.col("n"))
    sides = written(sides.select("id", "side", F.element_at("o", F.floor(F.size("o") / 2).cast("int") + 1).alias("offset")))
    chosen = sides.select(F.col("id").alias("road"), F.col("side").alias("_side"))
    pairs = seen.join(chosen, (F.col("id") == F.col("road")) & (F.col("side") == F.col("_side"))).select("road", "footway").distinct()
    return sides, pairs


def absorbed_footways(footways: DataFrame, roads: DataFrame, pairs: DataFrame, spacing: float, widest: int) -> DataFrame:
    """(id, owner): footways all of whose samples lie within the ``band`` of a road they are paired with (road, footway).

    The owner is the road that holds most of the samples, ties to the smaller id. No band may exceed ``widest``.
    """
    met = _met(footways, roads, spacing, widest).drop("b_seq", "b_hx", "b_hy").join(pairs, (F.col("a_id") == F.col("footway")) & (F.col("b_id") == F.col("road")))
    own = _sampled(met, spacing, widest).where(F.col("gap") <= F.col("b_band"))
    held = written(own.select(F.col("a_id").alias("id"), F.col("a_k").alias("k"), F.col("a_n").alias("n"), "road").distinct())
    whole = held.groupBy("id", "n").agg(F.count_distinct("k").alias("_k")).where("_k = n").select(F.col("id").alias("_id"))
    most = held.groupBy("id", "road").agg((-F.count(F.lit(1))).alias("less")).groupBy("id").agg(F.min(F.struct("less", "road")).alias("m"))
    return most.join(whole, F.col("id") == F.col("_id"), "left_semi").select("id", F.col("m.road").alias("owner"))
