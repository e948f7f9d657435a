"""Spatial joins by grid cells: candidates from an equi-join on cells, then an exact condition.

No operator forms a cross join. A pair is reported by one cell only (the one that holds the larger
of the two lower corners), so no distinct is needed. Cell size is a parameter; dense cells are a
skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import on_segment, point_segment_distance2, segment_gap2, segments_cross


def grown(df: DataFrame) -> DataFrame:
    """df, to be joined by sort and merge. Spark knows a table's size from before its rows were multiplied, and would
    send what it takes for a small table whole through the driver."""
    return df.hint("merge")


#: Rows that a task may make of the rows it is given.
MADE = 1 << 19


def spread(df: DataFrame, each: int, *keys: str) -> DataFrame:
    """df, of which each row will become about ``each``, dealt to as many tasks as that takes: tasks are cut by the bytes they
    read, so a small table, or one that adaptive execution has packed, would be multiplied in one task."""
    return df.repartition(max(1, math.ceil(df.count() * each / MADE)), *keys)


def cells(df: DataFrame, cell: int | Column, x0: Column, y0: Column, x1: Column, y1: Column, prefix: str = "") -> DataFrame:
    """Each row once for every cell that its box touches, with columns cx, cy."""
    cx = F.sequence(F.floor(x0 / cell), F.floor(x1 / cell))
    cy = F.sequence(F.floor(y0 / cell), F.floor(y1 / cell))
    return df.withColumn(f"{prefix}cx", F.explode(cx)).withColumn(f"{prefix}cy", F.explode(cy))


def _numbered_cells(df: DataFrame, cell: int | Column, x0: Column, y0: Column, x1: Column, y1: Column, prefix: str) -> DataFrame:
    """As ``cells``, with the cells' numbers nx and ny within the box, from 0."""
    for c, low, high in (("x", x0, x1), ("y", y0, y1)):
        df = df.select("*", F.posexplode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias(f"{prefix}n{c}", f"{prefix}c{c}"))
    return df


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are worked out once a row, one after the other. A filter on them stays above; pushed down, it would write their expressions out again
    at each use, and a generated method of over 8,000 bytes is never compiled by the JVM."""
    for name, value in values.items():
        df = df.withColumn(name, F.explode(F.array(value)))
    return df


def occupancy(records: DataFrame, cell: int, margin: int = 0) -> DataFrame:
    """(…, cx, cy): records (x0, y0, x1, y1) by the grid cells they touch with a margin."""
    m = F.lit(margin)
    return cells(records, cell, F.col("x0") - m, F.col("y0") - m, F.col("x1") + m, F.col("y1") + m)


def box_join(a: DataFrame, b: DataFrame, cell: int, reach: int = 0, same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) that overlap or lie within ``reach`` along both axes: columns a_*, b_*.

    ``same`` names a column of a and one of b that must be equal; it is part of the join key.
    """
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    r = F.lit(reach)
    left = _numbered_cells(left, cell, F.col("a_x0") - r, F.col("a_y0") - r, F.col("a_x1") + r, F.col("a_y1") + r, "l")
    right = _numbered_cells(right, cell, F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1"), "r")
    key = (F.col("lcx") == F.col("rcx")) & (F.col("lcy") == F.col("rcy"))
    if same:
        key = key & (F.col(f"a_{same[0]}") == F.col(f"b_{same[1]}"))
    both = left.join(grown(right), key)
    # the larger lower corner lies in the cell that is the first one of either box
    owner = ((F.col("lnx") == 0) | (F.col("rnx") == 0)) & ((F.col("lny") == 0) | (F.col("rny") == 0))
    touch = (F.col("a_x0") - r <= F.col("b_x1")) & (F.col("b_x0") - r <= F.col("a_x1")) & (F.col("a_y0") - r <= F.col("b_y1")) & (F.col("b_y0") - r <= F.col("a_y1"))
    return both.where(owner & touch).drop(*[f"{p}{c}" for p in "lr" for c in ("cx", "cy", "nx", "ny")])


def segment_cells(segs: DataFrame, size: Column, prefix: str = "") -> DataFrame:
    """Each segment once for every cell of the given size that it touches, along itself and not over its box."""
    x, y, x2, y2 = (F.col(c).cast("double") for c in ("x", "y", "x2", "y2"))
    column = F.explode(F.sequence(F.floor(F.least(x, x2) / size), F.floor(F.greatest(x, x2) / size)))
    by_column = segs.withColumn(f"{prefix}cx", column)
    cx, slope = F.col(f"{prefix}cx"), F.when(x2 != x, (y2 - y) / (x2 - x))
    ends = [F.least(F.greatest(edge, F.least(x, x2)), F.greatest(x, x2)) for edge in (cx * size, (cx + 1) * size)]
    at = [F.when(x2 == x, straight).otherwise(y + slope * (e - x)) for e, straight in zip(ends, (y, y2), strict=True)]
    room = F.lit(1e-6) * size  # for rounding; a cell too many costs a comparison, not a result
    low, high = F.greatest(F.least(*at) - room, F.least(y, y2)), F.least(F.greatest(*at) + room, F.greatest(y, y2))
    return by_column.withColumn(f"{prefix}cy", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def segment_pairs(a: DataFrame, b: DataFrame, cell: int, *same: str) -> DataFrame:
    """Pairs of segments (columns a_*, b_*) that share a cell and the ``same`` columns; a pair comes once for every cell it shares."""
    size = F.lit(cell)
    left, right = (segment_cells(s, size, "_").select(*[F.col(c).alias(f"{p}_{c}") for c in (*s.columns, "_cx", "_cy")]) for s, p in ((a, "a"), (b, "b")))
    keys = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("_cx", "_cy", *same)]
    boxes = [(F.greatest(f"{p}_{c}", f"{p}_{c}2") >= F.least(f"{q}_{c}", f"{q}_{c}2")) for c in "xy" for p, q in ("ab", "ba")]
    for k in (*keys[1:], *boxes):
        keys[0] = keys[0] & k
    return left.join(grown(right), keys[0]).drop("a__cx", "a__cy", "b__cx", "b__cy")


def boxed_points(points: DataFrame) -> DataFrame:
    return points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})


def boxed_segments(segs: DataFrame) -> DataFrame:
    return segs.withColumns({"x0": F.least("x", "x2"), "y0": F.least("y", "y2"), "x1": F.greatest("x", "x2"), "y1": F.greatest("y", "y2")})


def within_distance(a: DataFrame, b: DataFrame, radius: int, same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of points (id, x, y) at most ``radius`` apart, with d2: squared distance; ``same`` as for ``box_join``."""
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    pairs = box_join(boxed_points(a), boxed_points(b), max(1, radius), radius, same)
    return pairs.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)


def not_near(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Rows of a with no point of b within the radius."""
    near = within_distance(a, b, radius).select(F.col("a_id").alias("_near")).distinct()
    return a.join(near, F.col("id") == F.col("_near"), "left_anti")


def nearest_line(points: DataFrame, segs: DataFrame, reach: int) -> DataFrame:
    """For each point (id, x, y) the nearest segment's line within reach: (id, line, d2), ties to the smaller line."""
    pairs = box_join(boxed_points(points), boxed_segments(segs), max(1, reach), reach)
    d2 = point_segment_distance2(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"), F.col("b_x2"), F.col("b_y2"))
    near = pairs.withColumn("d2", d2).where(F.col("d2") <= float(reach) ** 2)
    best = near.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct("d2", F.col("b_id").alias("line"))).alias("best"))
    return best.select("id", F.col("best.line").alias("line"), F.col("best.d2").alias("d2"))


def crossings(segs: DataFrame, cell: int) -> DataFrame:
    """Proper crossings of segments (id, seq, x, y, x2, y2) of different lines: (a_id, a_seq, b_id, b_seq, a_id < b_id)."""
    pairs = segment_pairs(segs, segs, cell).where("a_id < b_id")
    c = [F.col(x) for x in ("a_x", "a_y", "a_x2", "a_y2", "b_x", "b_y", "b_x2", "b_y2")]
    return pairs.where(segments_cross(*c)).select("a_id", "a_seq", "b_id", "b_seq").distinct()


#: A polygon's box covers at most this many cells along each axis; larger ones get larger cells.
ACROSS = 8


def _level(cell: int) -> Column:
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1.0)) / (ACROSS * cell))).cast("int"))


def _levels(boxes: DataFrame, cell: int) -> tuple[DataFrame, list[int]]:
    """Boxes with the level of their cells (cell * 2**level), and the levels there are: one for each doubling of an extent."""
    found = boxes.withColumn("level", _level(cell))
    return found, sorted(r["level"] for r in found.select("level").distinct().collect())


def _parity(points: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """Points (id, polygon, level, x, y) with n, the edges of their polygon to their right, and ``on``: whether one holds them.

    A ray to the right crosses only edges in the point's row; a polygon of a high level has rows a 64th as high as its cells.
    """
    size = F.lit(cell) * F.pow(F.lit(2), F.greatest(F.lit(0), F.col("level") - 6))
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(F.least("e_y", "e_y2") / size), F.floor(F.greatest("e_y", "e_y2") / size))))
    at = points.withColumn("row", F.floor(F.col("y") / size)).drop("level")
    both = at.join(rows, ["polygon", "row"])
    both = both.where((F.col("x") <= F.greatest("e_x", "e_x2")) & F.col("y").between(F.least("e_y", "e_y2"), F.greatest("e_y", "e_y2")))
    spans = (F.col("e_y") > F.col("y")) != (F.col("e_y2") > F.col("y"))
    side = (F.col("e_x2") - F.col("e_x")) * (F.col("y") - F.col("e_y")) - (F.col("x") - F.col("e_x")) * (F.col("e_y2") - F.col("e_y"))
    right = F.when(F.col("e_y2") > F.col("e_y"), side > 0).otherwise(side < 0)
    on = on_segment(F.col("x"), F.col("y"), F.col("e_x"), F.col("e_y"), F.col("e_x2"), F.col("e_y2"))
    return both.groupBy("id", "polygon").agg(F.sum((spans & right).cast("int")).alias("n"), F.max(on).alias("on"))


def _inner_cells(held: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """Cells (polygon, level, cx, cy) of large polygons with what is known of them: ``edge`` if a boundary may pass, else ``inner``; outer cells go."""
    size = F.lit(cell) * F.pow(F.lit(2), F.col("level"))
    named = edges.where("level > 0").select("polygon", "level", *[F.col(f"e_{c}").alias(c) for c in ("x", "y", "x2", "y2")])
    touched = segment_cells(named, size, "_").select(F.col("polygon").alias("_p"), "_cx", "_cy").distinct()
    both = held.join(touched, (F.col("polygon") == F.col("_p")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")), "left")
    free = both.where("_p IS NULL").select(F.struct("cx", "cy").alias("id"), "polygon", "level", ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    inner = _parity(free, edges, cell).where("n % 2 = 1").select(F.col("polygon").alias("_q"), F.col("id.cx").alias("_ix"), F.col("id.cy").alias("_iy"))
    known = both.join(inner, (F.col("polygon") == F.col("_q")) & (F.col("cx") == F.col("_ix")) & (F.col("cy") == F.col("_iy")), "left")
    return known.where("_p IS NOT NULL OR _q IS NOT NULL").select("polygon", "level", "cx", "cy", "x0", "y0", "x1", "y1", F.col("_q").isNotNull().alias("inner"))


def _named_edges(edges: DataFrame, *tie: str) -> DataFrame:
    return edges.select(F.col("id").alias("polygon"), *tie, *[F.col(c).alias(f"e_{c}") for c in ("x", "y", "x2", "y2")])


def _boxes(e: DataFrame, *tie: str) -> DataFrame:
    low, high = (lambda c: F.min(F.least(f"e_{c}", f"e_{c}2"))), (lambda c: F.max(F.greatest(f"e_{c}", f"e_{c}2")))
    return e.groupBy("polygon", *tie).agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


def polygon_boxes(edges: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1) of polygons given as ring edges (id, x, y, x2, y2)."""
    return _boxes(_named_edges(edges)).withColumnRenamed("polygon", "id")


def in_named_polygons(points: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """(id, polygon, on): points (id, polygon, x, y) that lie in the polygon they name, or ``on`` an edge of it."""
    e = _named_edges(edges)
    level = _boxes(e).select(F.col("polygon").alias("_b"), _level(cell).alias("level"))
    e = e.join(level, F.col("polygon") == F.col("_b")).drop("_b")
    found = _parity(points.select("id", "polygon", F.lit(0).alias("level"), "x", "y").join(level.withColumnRenamed("level", "_level"), F.col("polygon") == F.col("_b")).select("id", "polygon", F.col("_level").alias("level"), "x", "y"), e, cell)
    return found.where(F.col("on") | (F.col("n") % 2 == 1)).select("id", "polygon", "on")


def points_in_polygons(points: DataFrame, edges: DataFrame, cell: int, boundary: bool = True, same: str | None = None) -> DataFrame:
    """(id, polygon): points in polygons given as ring edges (id, x, y, x2, y2), holes included as further rings.

    Points first meet the polygons whose boxes hold them, by grid cells of both axes; a ray to the right
    of such a point crosses the edges of its polygon in the point's row of cells, and an odd count is
    inside. Points on an edge count if ``boundary``. A large polygon has larger cells, by powers of two, so that its box is
    ``ACROSS`` + 1 cells wide at most; those of its cells that no edge passes lie inside or outside as a
    whole, and points in them are answered without edges. With ``same``, a column of both sides, points meet only polygons of equal value.
    """
    tie = [same] if same else []
    e = _named_edges(edges, *tie)
    boxes, levels = _levels(_boxes(e, *tie), cell)
    size = F.lit(cell) * F.pow(F.lit(2), F.col("level"))
    held = cells(boxes, size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    if levels and levels[-1] > 0:
        e = e.join(boxes.select(F.col("polygon").alias("_b"), "level"), F.col("polygon") == F.col("_b")).drop("_b")
        large = _inner_cells(held.where("level > 0").drop(*tie), e, cell)
        if tie:
            large = large.join(boxes.select(F.col("polygon").alias("_b"), same), F.col("polygon") == F.col("_b")).drop("_b")
        small = held.where("level = 0").withColumn("inner", F.lit(False))
        held = small.unionByName(large.select(small.columns))
    else:
        held, e = held.withColumn("inner", F.lit(False)), e.withColumn("level", F.lit(0))
    at = points.select("id", *tie, "x", "y", F.explode(F.array(*map(F.lit, levels or [0]))).alias("level"))
    at = at.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    near = at.join(held, [*tie, "level", "cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    found = _parity(near.where("NOT inner").select("id", "polygon", "level", "x", "y"), e.drop(*tie), cell)
    inside = F.col("on") | (F.col("n") % 2 == 1) if boundary else ~F.col("on") & (F.col("n") % 2 == 1)
    found = found.where(inside).select("id", "polygon")
    return found if not levels or levels[-1] == 0 else found.unionByName(near.where("inner").select("id", "polygon"))


def first_region(points: DataFrame, inside: DataFrame, regions: DataFrame, default: str) -> DataFrame:
    """For each point the containing region that comes first in order (polygon, ord, region), or the default."""
    hit = inside.join(regions, "polygon").groupBy("id").agg(F.min(F.struct("ord", "region")).alias("m")).select(F.col("id").alias("_id"), F.col("m.region").alias("region"))
    return points.join(hit, F.col("id") == F.col("_id"), "left").drop("_id").withColumn("region", F.coalesce("region", F.lit(default)))


def smallest_site(points: DataFrame, inside: DataFrame, areas: DataFrame, tile: int) -> DataFrame:
    """(id, kind, key): the smallest enclosing site (ties: smaller polygon), else the tile that holds the point."""
    hit = inside.join(areas, "polygon").groupBy("id").agg(F.min(F.struct("area", "polygon")).alias("m")).select(F.col("id").alias("_id"), F.col("m.polygon").alias("site"))
    both = points.join(hit, F.col("id") == F.col("_id"), "left")
    at = F.concat_ws(":", F.floor(F.col("x") / tile).cast("string"), F.floor(F.col("y") / tile).cast("string"))
    return both.select("id", F.when(F.col("site").isNotNull(), "site").otherwise("tile").alias("kind"), F.coalesce(F.col("site").cast("string"), at).alias("key"))


def bilinear(points: DataFrame, grid: DataFrame, west: float, south: float, step: float) -> DataFrame:
    """(id, h): grid heights (row, col, h) interpolated at points; points without all four corners get null."""
    at = points.select("id", "x", "y").withColumns({"_u": (F.col("x") - west) / step, "_v": (F.col("y") - south) / step})
    at = at.withColumns({"_c": F.floor("_u"), "_r": F.floor("_v")}).withColumns({"_fu": F.col("_u") - F.col("_c"), "_fv": F.col("_v") - F.col("_r")})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    four = at.withColumn("_k", F.explode(corners)).withColumns({"_row": F.col("_r") + F.col("_k.j"), "_col": F.col("_c") + F.col("_k.i")})
    w = F.when(F.col("_k.i") == 1, F.col("_fu")).otherwise(1 - F.col("_fu")) * F.when(F.col("_k.j") == 1, F.col("_fv")).otherwise(1 - F.col("_fv"))
    four = four.withColumn("_w", w)
    g = grid.select(F.col("row").alias("g_row"), F.col("col").alias("g_col"), "h")
    hit = four.join(g, (F.col("_row") == F.col("g_row")) & (F.col("_col") == F.col("g_col")), "left")
    # a corner of no weight needs no sample: points on the last row or column
    need = F.sum((F.col("h").isNull() & (F.col("_w") > 0)).cast("int"))
    return hit.groupBy("id").agg(F.sum(F.col("_w") * F.col("h")).alias("_h"), need.alias("_missing")).select("id", F.when(F.col("_missing") == 0, F.col("_h")).alias("h"))


def corridor(segs: DataFrame, cell: int, clearance: int = 0) -> DataFrame:
    """(id, cx, cy): cells whose centre lies within half the width (column ``width``) plus a clearance of one of a road's segments."""
    reach = F.col("width") / 2.0 + clearance
    near = cells(boxed_segments(segs), cell, F.col("x0") - reach, F.col("y0") - reach, F.col("x1") + reach, F.col("y1") + reach)
    centre = [(F.col(c) * cell + cell / 2.0) for c in ("cx", "cy")]
    d2 = point_segment_distance2(*centre, F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    return near.where(d2 <= reach * reach).select("id", "cx", "cy").distinct()


def space_share(footprints: DataFrame, space: DataFrame, cell: int) -> DataFrame:
    """(id, n, taken): cells with their centre in each footprint (id, x0, y0, x1, y1), and how many of them lie in the space (cx, cy)."""
    half = cell / 2.0
    first = [F.ceil((F.col(c) - half) / cell) for c in ("x0", "y0")]
    last = [F.floor((F.col(c) - half) / cell) for c in ("x1", "y1")]
    some = footprints.where((first[0] <= last[0]) & (first[1] <= last[1]))
    own = some.withColumn("cx", F.explode(F.sequence(first[0], last[0]))).withColumn("cy", F.explode(F.sequence(first[1], last[1]))).select("id", "cx", "cy")
    held = space.select(F.col("cx").alias("_x"), F.col("cy").alias("_y")).distinct()
    both = own.join(held, (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")), "left")
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("_x").alias("taken"))


def probes_hit(probes: DataFrame, edges: DataFrame, cell: int, reach: int = 0) -> DataFrame:
    """The probes (id, seq, x, y, x2, y2) that cross, touch or come within ``reach`` of an edge of anything."""
    pairs = box_join(boxed_segments(probes), boxed_segments(edges), cell, reach)
    gap = segment_gap2(*[F.col(f"{s}_{c}") for s in "ab" for c in ("x", "y", "x2", "y2")])
    near = pairs.where(gap <= float(reach) ** 2).select(F.col("a_id").alias("_id"), F.col("a_seq").alias("_seq")).distinct()
    return probes.join(near, (F.col("id") == F.col("_id")) & (F.col("seq") == F.col("_seq")), "left_semi")


def zone_entries(segs: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """(id, zone, seq, x, y, enters): where a line (id, seq, x, y, x2, y2) crosses a zone's edge, and whether it goes in (rings counter-clockwise)."""
    pairs = box_join(boxed_segments(segs), boxed_segments(edges), cell)
    c = [F.col(f"{s}_{k}") for s in "ab" for k in ("x", "y", "x2", "y2")]
    ax, ay, bx, by, px, py, qx, qy = c
    turn = (qx - px) * (by - ay) - (qy - py) * (bx - ax)
    t = ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / ((bx - ax) * (qy - py) - (by - ay) * (qx - px)).cast("double")
    at = [F.round(a + t * (b - a), 3) for a, b in ((ax, bx), (ay, by))]
    return pairs.where(segments_cross(*c)).select(F.col("a_id").alias("id"), F.col("b_id").alias("zone"), F.col("a_seq").alias("seq"), at[0].alias("x"), at[1].alias("y"), (turn > 0).alias("enters"))
