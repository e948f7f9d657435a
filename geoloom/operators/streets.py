"""Streets against what stands beside and across them: water, gates, street points, opposite carriageways, sections and related sites.

Lines are segment rows (id, seq, x, y, x2, y2), polygons ring edges of the same shape. Candidates come
from the grid joins of ``spatial``; nothing is compared beyond a stated reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import _kept
from geoloom.operators.sequences import arc_length, split_at
from geoloom.operators.spatial import box_join, boxed_points, boxed_segments, points_in_polygons, within_distance


def _meeting() -> tuple[Column, Column]:
    """(t, u): where segments a and b of a box join meet, as fractions of each; null where they are parallel."""
    ax, ay, bx, by = (F.col(f"a_{c}").cast("double") for c in ("x", "y", "x2", "y2"))
    px, py, qx, qy = (F.col(f"b_{c}").cast("double") for c in ("x", "y", "x2", "y2"))
    under = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
    under = F.when(under != 0, under)
    return ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / under, ((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / under


def wet_length(segs: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """(id, wet): length of each line strictly inside any polygon; stretches that several polygons share count once.

    A segment is cut where it meets an edge, and each piece is inside or outside by its middle. Dry lines have 0.
    """
    t, u = _meeting()
    met = box_join(boxed_segments(segs), boxed_segments(edges), cell).withColumns({"t": t, "u": u})
    cuts = met.where("t > 0 AND t < 1 AND u BETWEEN 0 AND 1").groupBy(F.col("a_id").alias("_id"), F.col("a_seq").alias("_seq")).agg(F.collect_set("t").alias("ts"))
    both = segs.join(cuts, (F.col("id") == F.col("_id")) & (F.col("seq") == F.col("_seq")), "left")
    marks = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>"))))
    spans = F.transform(F.sequence(F.lit(1), F.size(marks) - 1), lambda i: F.struct(F.element_at(marks, i).alias("lo"), F.element_at(marks, i + 1).alias("hi")))
    part = both.select("id", "seq", "x", "y", "x2", "y2", F.posexplode(spans).alias("part", "s")).withColumn("_m", (F.col("s.lo") + F.col("s.hi")) / 2)
    size = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) * (F.col("s.hi") - F.col("s.lo"))
    part = part.select(F.struct("id", "seq", "part").alias("id"), size.alias("size"), (F.col("x") + F.col("_m") * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + F.col("_m") * (F.col("y2") - F.col("y"))).alias("y"))
    inside = points_in_polygons(part, edges, cell, boundary=False).select(F.col("id").alias("_in")).distinct()
    hit = part.join(inside, F.col("id") == F.col("_in"), "left")
    return hit.groupBy(F.col("id.id").alias("id")).agg(F.sum(F.when(F.col("_in").isNotNull(), F.col("size")).otherwise(0.0)).alias("wet"))


def gate_cuts(barriers: DataFrame, ways: DataFrame, gates: DataFrame, cell: int, margin: float) -> DataFrame:
    """(id, start, stop): what is left of each barrier, by distance along it.

    Half a way's width and a margin go on both sides of a crossing, and what a gate's circle (id, x, y, width) covers.
    """
    own = arc_length(barriers)
    t, u = _meeting()
    met = box_join(boxed_segments(own), boxed_segments(ways), cell).withColumns({"t": t, "u": u}).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    middle, half = F.col("a_at") + F.col("t") * F.col("a_len"), F.col("b_width") / 2.0 + margin
    crossed = met.select(F.col("a_id").alias("id"), (middle - half).alias("start"), (middle + half).alias("stop"))
    r = F.ceil(F.col("width") / 2.0)
    circles = gates.withColumns({"x0": F.col("x") - r, "y0": F.col("y") - r, "x1": F.col("x") + r, "y1": F.col("y") + r})
    near = box_join(boxed_segments(own), circles, cell)
    dx, dy = F.col("a_x2") - F.col("a_x"), F.col("a_y2") - F.col("a_y")
    ex, ey = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    along, off = (ex * dx + ey * dy) / F.col("a_len"), (ex * dy - ey * dx) / F.col("a_len")
    reach2 = (F.col("b_width") / 2.0) ** 2 - off * off
    chord = near.where(F.col("a_len") > 0).withColumns({"m": along, "r2": reach2}).where("r2 > 0").withColumn("r", F.sqrt("r2"))
    gated = chord.select(F.col("a_id").alias("id"), (F.col("a_at") + F.greatest(F.col("m") - F.col("r"), F.lit(0.0))).alias("start"), (F.col("a_at") + F.least(F.col("m") + F.col("r"), F.col("a_len"))).alias("stop")).where("start < stop")
    ends = own.groupBy("id").agg(F.max("total").alias("start")).select("id", "start", F.col("start").alias("stop"))
    order = Window.partitionBy("id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    cuts = crossed.unionByName(gated).unionByName(ends).withColumn("_from", F.greatest(F.coalesce(F.max("stop").over(order), F.lit(0.0)), F.lit(0.0)))
    return cuts.where("_from < start").select("id", F.col("_from").alias("start"), F.col("start").alias("stop"))


def snap_to_side(points: DataFrame, segs: DataFrame, reach: int, gap: float) -> DataFrame:
    """(id, line, side, x, y): points put beside the nearest line within reach, ties to the smaller line, half its ``width`` and a gap from its middle.

    Side 1 is left of the line's direction and takes points on the line itself; -1 is right.
    """
    pairs = box_join(boxed_points(points), boxed_segments(segs), max(1, reach), reach)
    dx, dy = F.col("b_x2") - F.col("b_x"), F.col("b_y2") - F.col("b_y")
    ex, ey = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    size2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / size2.cast("double")))
    foot = pairs.where(size2 > 0).withColumn("t", t).withColumns({"fx": F.col("b_x") + F.col("t") * dx, "fy": F.col("b_y") + F.col("t") * dy})
    d2 = (F.col("a_x") - F.col("fx")) ** 2 + (F.col("a_y") - F.col("fy")) ** 2
    side = F.when(dx * ey - dy * ex >= 0, 1).otherwise(-1)
    away, size = F.col("b_width") / 2.0 + gap, F.sqrt(size2.cast("double"))
    found = foot.withColumns({"d2": d2, "side": side}).where(F.col("d2") <= float(reach) ** 2)
    place = F.struct("d2", F.col("b_id").alias("line"), F.col("b_seq").alias("seq"), "side", (F.col("fx") - F.col("side") * away * dy / size).alias("x"), (F.col("fy") + F.col("side") * away * dx / size).alias("y"))
    return found.groupBy(F.col("a_id").alias("id")).agg(F.min(place).alias("p")).select("id", "p.line", "p.side", "p.x", "p.y")


def opposite(segs: DataFrame, near: float, far: float, cell: int, angle: float = 35.0) -> DataFrame:
    """(id, seq, side, other): one-way segments (one_way 1 or -1, width) with a one-way line of the other direction beyond their edge.

    A probe runs square from the segment's middle, from ``near`` to ``far`` beyond its edge, on both sides;
    of the lines it meets that head back within ``angle`` degrees the nearest counts, ties to the smaller.
    """
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    size = F.sqrt((dx * dx + dy * dy).cast("double"))
    known = segs.where(F.col("one_way").isin(1, -1) & (size > 0)).withColumns({"hx": F.col("one_way") * dx / size, "hy": F.col("one_way") * dy / size, "nx": -dy / size, "ny": dx / size})
    mx, my = (F.col("x") + F.col("x2")) / 2.0, (F.col("y") + F.col("y2")) / 2.0
    side = F.explode(F.array(F.lit(1), F.lit(-1)))
    probe = known.select("id", "seq", "hx", "hy", side.alias("side"), mx.alias("mx"), my.alias("my"), "nx", "ny", (F.col("width") / 2.0).alias("half"))
    ends = {c: F.col(f"m{a}") + F.col("side") * F.col(f"n{a}") * (F.col("half") + d) for c, a, d in (("x", "x", near), ("y", "y", near), ("x2", "x", far), ("y2", "y", far))}
    t, u = _meeting()
    met = box_join(boxed_segments(probe.withColumns(ends)), boxed_segments(known), cell).withColumns({"t": t, "u": u})
    back = F.col("a_hx") * F.col("b_hx") + F.col("a_hy") * F.col("b_hy") <= -math.cos(math.radians(angle))
    found = met.where((F.col("a_id") != F.col("b_id")) & F.col("t").between(0, 1) & F.col("u").between(0, 1) & back)
    return found.groupBy(F.col("a_id").alias("id"), F.col("a_seq").alias("seq"), F.col("a_side").alias("side")).agg(F.min(F.struct("t", F.col("b_id").alias("other"))).alias("m")).select("id", "seq", "side", "m.other")


def related(sites: DataFrame, rules: DataFrame, labels: DataFrame, radius: int) -> DataFrame:
    """(id, grp, other, connected): for each site (id, grp, x, y, node) and rule (grp, adjacent) the nearest site of the adjacent group, ties to the smaller id, and whether a route joins their nodes.

    The search begins with ``radius`` and doubles for those that have found nothing, so each sees few candidates; the group is
    part of the join's key, so a rare one is compared with its own few sites alone. Rules x groups are broadcast: a few kinds.
    ``labels`` are (node, component). Groups without a site give no row.
    """
    there = sites.groupBy(F.col("grp").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = rules.join(there, F.col("adjacent") == F.col("_g")).select(F.col("grp").alias("_own"), "adjacent")
    left = _kept(sites.join(F.broadcast(pairs), F.col("grp") == F.col("_own")).select("id", "x", "y", "adjacent"))
    span = sites.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0
    goal = sites.select("id", "x", "y", "grp")
    found = None
    while not left.isEmpty():
        near = within_distance(left, goal, radius, ("adjacent", "grp")).where("a_id <> b_id")
        best = _kept(near.groupBy(F.col("a_id").alias("id"), F.col("a_adjacent").alias("grp")).agg(F.min(F.struct("d2", "b_id")).alias("m")).select("id", "grp", F.col("m.b_id").alias("other")))
        found = best if found is None else found.unionByName(best)
        if radius > 2 * span:
            break
        done = best.select(F.col("id").alias("_id"), F.col("grp").alias("_grp"))
        left = _kept(left.join(done, (F.col("id") == F.col("_id")) & (F.col("adjacent") == F.col("_grp")), "left_anti"))
        radius *= 2
    if found is None:
        found = left.select("id", F.col("adjacent").alias("grp"), F.col("id").alias("other"))
    at = sites.select(F.col("id").alias("_s"), "node").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("_s", "component")
    own, its = at.select(F.col("_s").alias("_a"), F.col("component").alias("_ca")), at.select(F.col("_s").alias("_b"), F.col("component").alias("_cb"))
    both = found.join(own, F.col("id") == F.col("_a")).join(its, F.col("other") == F.col("_b"))
    return both.select("id", "grp", "other", F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False)).alias("connected"))


def level_ways(ways: DataFrame, unshared: DataFrame) -> DataFrame:
    """The ways that cross nothing without a shared node; ``unshared`` are such crossings (a_id, b_id)."""
    met = unshared.select(F.explode(F.array("a_id", "b_id")).alias("_met")).distinct()
    return ways.join(met, F.col("id") == F.col("_met"), "left_anti")


def sections(points: DataFrame) -> DataFrame:
    """Ways (id, seq, ref) cut at interior nodes that another way holds too: (…, piece); a way that touches a closed way stays whole."""
    uses = points.select("id", "ref").distinct().groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    shared = uses.where("n > 1").select("ref")
    closed = points.groupBy("id").agg(F.min_by("ref", "seq").alias("a"), F.max_by("ref", "seq").alias("b"), F.count(F.lit(1)).alias("n")).where("a = b AND n > 1").select(F.col("id").alias("_closed"))
    on_loop = points.join(closed, F.col("id") == F.col("_closed"), "left_semi").select(F.col("ref").alias("_ref")).distinct()
    whole = points.join(on_loop, F.col("ref") == F.col("_ref"), "left_semi").select(F.col("id").alias("_whole")).distinct()
    free = points.join(whole, F.col("id") == F.col("_whole"), "left_anti")
    held = points.join(whole, F.col("id") == F.col("_whole"), "left_semi").withColumn("piece", F.lit(0).cast("bigint"))
    return split_at(free, shared).unionByName(held, allowMissingColumns=True)


def admitted(pieces: DataFrame) -> DataFrame:
    """(id, pieces, fine): ways (id, piece, ok, structure) with a piece that could be built; a structure needs all of its pieces."""
    g = pieces.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.count_if("ok").alias("fine"), F.bool_or("structure").alias("_s"))
    return g.where((F.col("fine") > 0) & (~F.col("_s") | (F.col("fine") == F.col("pieces")))).drop("_s")


def check_parts(parents: DataFrame, parts: DataFrame, cell: int) -> DataFrame:
    """(id, fault): parents (ring edges) that their parts (ring edges with ``parent``) don't cover exactly.

    'missing' without parts, 'outside' if a part leaves its parent, 'overlap' if two parts of one parent
    cross or hold each other's corners, 'area' if together they are smaller or larger than it.
    """
    area = lambda: F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")))
    own = parents.groupBy("id").agg(area().alias("area2"))
    each = parts.groupBy("parent", F.col("id").alias("_part")).agg(area().alias("part2"))
    total = each.groupBy(F.col("parent").alias("_p")).agg(F.sum("part2").alias("sum2"))
    t, u = _meeting()
    proper = "t > 0 AND t < 1 AND u > 0 AND u < 1"
    boxed = boxed_segments(parts)
    leaves = box_join(boxed, boxed_segments(parents), cell).where("a_parent = b_id").withColumns({"t": t, "u": u}).where(proper).select(F.col("b_id").alias("id"))
    corners = parts.select(F.struct("parent", F.col("id").alias("part"), "seq").alias("id"), "x", "y")
    home = points_in_polygons(corners, parents, cell).where("id.parent = polygon").select(F.col("id").alias("_id"))
    strays = corners.join(home, F.col("id") == F.col("_id"), "left_anti").select(F.col("id.parent").alias("id"))
    outside = leaves.union(strays).distinct().select(F.col("id").alias("_o"))
    across = box_join(boxed, boxed, cell).where("a_parent = b_parent AND a_id < b_id").withColumns({"t": t, "u": u}).where(proper).select(F.col("a_parent").alias("id"))
    owner = parts.select(F.col("id").alias("_part"), F.col("parent").alias("_parent")).distinct()
    deep = points_in_polygons(corners, parts.drop("parent"), cell, boundary=False).join(owner, F.col("polygon") == F.col("_part")).where("id.parent = _parent AND id.part <> polygon").select(F.col("_parent").alias("id"))
    overlap = across.union(deep).distinct().select(F.col("id").alias("_x"))
    all_ = own.join(total, F.col("id") == F.col("_p"), "left").join(outside, F.col("id") == F.col("_o"), "left").join(overlap, F.col("id") == F.col("_x"), "left")
    fault = F.when(F.col("_p").isNull(), "missing").when(F.col("_o").isNotNull(), "outside").when(F.col("_x").isNotNull(), "overlap").when(F.col("sum2") != F.col("area2"), "area")
    return all_.select("id", fault.alias("fault")).where("fault IS NOT NULL")
