"""Matching and fusing sources in space, cell paint, raster statistics, greedy choices and simplification."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.operators.graph import _kept
from geoloom.operators.sequences import best
from geoloom.operators.spatial import box_join, crossings, points_in_polygons, spread, within_distance


def box_area(p: str) -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlaps(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of boxes with their common area and iou (intersection over union)."""
    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    pairs = box_join(a, b, cell).withColumn("common", w * h).where(F.col("common") > 0)
    return pairs.withColumn("iou", F.col("common") / (box_area("a_") + box_area("b_") - F.col("common")))


def best_match(a: DataFrame, b: DataFrame, cell: int, least: float, same_source: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id, basis): for each footprint of a the one of b that shares its source id, else that of the largest iou of at least ``least``; ties to the smaller b."""
    pairs = overlaps(a, b, cell).where(F.col("iou") >= least).select("a_id", "b_id", F.lit("overlap").alias("basis"), "iou")
    if same_source is not None:
        pairs = pairs.unionByName(same_source.select("a_id", "b_id", F.lit("source").alias("basis"), F.lit(2.0).alias("iou")))
    return best(pairs, ["a_id"], F.desc("iou"), F.col("b_id")).select("a_id", "b_id", "basis")


def fuse(primary: DataFrame, auxiliary: DataFrame, cell: int, least: float, same_source: DataFrame | None = None) -> DataFrame:
    """(id, verdict) of auxiliary footprints: duplicate of a primary one, conflict (overlaps without matching), or added."""
    match = best_match(auxiliary, primary, cell, least, same_source).select(F.col("a_id").alias("_m"))
    touch = overlaps(auxiliary, primary, cell).select(F.col("a_id").alias("_t")).distinct()
    both = auxiliary.join(match, F.col("id") == F.col("_m"), "left").join(touch, F.col("id") == F.col("_t"), "left")
    return both.select("id", F.when(F.col("_m").isNotNull(), "duplicate").when(F.col("_t").isNotNull(), "conflict").otherwise("added").alias("verdict"))


def coverage(sites: DataFrame, buildings: DataFrame, cell: int) -> DataFrame:
    """(id, share, tall): built share of each site's area and its number of tall buildings (``tall`` flag)."""
    pairs = overlaps(sites, buildings, cell)
    area = sites.select(F.col("id").alias("_s"), box_area("").alias("_area"))
    found = pairs.groupBy("a_id").agg(F.sum("common").alias("_c"), F.count_if("b_tall").alias("tall"))
    return area.join(found, F.col("_s") == F.col("a_id"), "left").select(F.col("_s").alias("id"), (F.coalesce("_c", F.lit(0)) / F.col("_area")).alias("share"), F.coalesce("tall", F.lit(0)).alias("tall"))


def paint(sources: DataFrame, cell: int) -> DataFrame:
    """(cx, cy, id, style, contributing): each cell with its centre in a source box takes the first by (priority, style, id); blocked cells go."""
    half = cell / 2
    span = lambda a, b: F.explode(F.sequence(F.ceil((F.col(a) - half) / cell), F.floor((F.col(b) - half) / cell)))
    fits = sources.where((F.ceil((F.col("x0") - half) / cell) <= F.floor((F.col("x1") - half) / cell)) & (F.ceil((F.col("y0") - half) / cell) <= F.floor((F.col("y1") - half) / cell)))
    most = fits.agg(F.avg((F.col("x1") - F.col("x0") + cell) * (F.col("y1") - F.col("y0") + cell))).first()[0] or 0
    cells = spread(fits, int(most / cell**2) + 1, "id").withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    top = cells.groupBy("cx", "cy").agg(F.min(F.struct("priority", "style", "id", "blocked")).alias("m"), F.count(F.lit(1)).alias("contributing"), F.bool_or("blocked").alias("_b"))
    return top.where("NOT _b").select("cx", "cy", "m.id", "m.style", "contributing")


def tile_samples(points: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """(id, h): heights of a mosaic of square tiles (tx, ty, row, col, h) at points in sample units, interpolated across tile edges."""
    at = points.select("id", "x", "y").withColumns({"_c": F.floor("x"), "_r": F.floor("y")}).withColumns({"_u": F.col("x") - F.col("_c"), "_v": F.col("y") - F.col("_r")})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    four = at.withColumn("k", corner).withColumns({"_gc": F.col("_c") + F.col("k.i"), "_gr": F.col("_r") + F.col("k.j")})
    weight = F.when(F.col("k.i") == 1, F.col("_u")).otherwise(1 - F.col("_u")) * F.when(F.col("k.j") == 1, F.col("_v")).otherwise(1 - F.col("_v"))
    four = four.select("id", weight.alias("w"), F.floor(F.col("_gc") / size).alias("_tx"), F.floor(F.col("_gr") / size).alias("_ty"), F.pmod("_gc", F.lit(size)).alias("_col"), F.pmod("_gr", F.lit(size)).alias("_row"))
    cond = [four[f"_{c}"] == tiles[c] for c in ("tx", "ty", "row", "col")]
    hit = four.join(tiles, cond, "left")
    lost = F.sum((F.col("h").isNull() & (F.col("w") > 0)).cast("int"))
    return hit.groupBy("id").agg(F.sum(F.col("w") * F.col("h")).alias("_h"), lost.alias("_lost")).select("id", F.when(F.col("_lost") == 0, F.col("_h")).alias("h"))


def ground_levels(samples: DataFrame) -> DataFrame:
    """(id, low, middle, high, n) of height samples (id, h); a footprint or outline with any missing sample gets null levels."""
    g = samples.groupBy("id").agg(F.min("h").alias("low"), F.median("h").alias("middle"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n"), F.count("h").alias("_got"))
    whole = F.col("n") == F.col("_got")
    return g.select("id", *[F.when(whole, F.col(c)).alias(c) for c in ("low", "middle", "high")], "n")


def blocks_touched(samples: DataFrame, height: int, width: int, bytes_each: int) -> DataFrame:
    """(tile, blocks, bytes): distinct raster blocks that samples touch and the bytes that decoding them takes."""
    b = samples.select("tile", F.floor(F.col("row") / height).alias("r"), F.floor(F.col("col") / width).alias("c")).distinct()
    return b.groupBy("tile").agg(F.count(F.lit(1)).alias("blocks")).withColumn("bytes", F.col("blocks") * bytes_each)


def quantised(raster: DataFrame, step: float) -> DataFrame:
    """(…, q, error): heights as whole steps above the tile's lowest, halves to even, and what that loses."""
    low = raster.groupBy(F.col("tile").alias("_tile")).agg(F.min("h").alias("offset"))
    q = F.bround((F.col("h") - F.col("offset")) / step)
    both = raster.join(low, F.col("tile").eqNullSafe(F.col("_tile"))).drop("_tile")
    return both.withColumn("q", q.cast("bigint")).withColumn("error", F.abs(F.col("offset") + q * step - F.col("h")))


def connector_faults(uses: DataFrame, segs: DataFrame, connectors: DataFrame, most: float) -> DataFrame:
    """(id, connector, fault): connectors that are unknown, repeated, or farther than ``most`` from their segment's line."""
    from geoloom.functions.geometry import point_segment_distance2

    c = connectors.groupBy("connector").agg(F.min("x").alias("px"), F.min("y").alias("py"), F.count(F.lit(1)).alias("n")).withColumnRenamed("connector", "_c")
    known = uses.join(c, F.col("connector") == F.col("_c"), "left")
    s = segs.withColumnRenamed("id", "_id")
    d2 = point_segment_distance2(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    near = known.join(s, F.col("id") == F.col("_id"), "left").groupBy("id", "connector").agg(F.min(d2).alias("d2"), F.max("n").alias("n"))
    fault = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.coalesce("d2", F.lit(float("inf"))) > most * most, "off the line")
    return near.select("id", "connector", fault.alias("fault")).where("fault IS NOT NULL")


def insert_points(points: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (id, seq, ref, x, y) with a vertex put between two neighbours; edits (id, a, b, x, y) that fit no or several places are given back and change nothing."""
    order = Window.partitionBy("id").orderBy("seq")
    pairs = points.select("id", "seq", F.col("ref").alias("r1"), F.lead("ref").over(order).alias("r2"), F.lead("seq").over(order).alias("seq2"))
    e = edits.select(F.col("id").alias("eid"), "a", "b", F.col("x").alias("ex"), F.col("y").alias("ey"))
    hit = e.join(pairs, (F.col("eid") == F.col("id")) & (F.least("a", "b") == F.least("r1", "r2")) & (F.greatest("a", "b") == F.greatest("r1", "r2")), "left")
    places = hit.groupBy("eid", "a", "b", "ex", "ey").agg(F.count("seq").alias("n"), F.min("seq").alias("seq"), F.min("seq2").alias("seq2"))
    fresh = places.where("n = 1").select(F.col("eid").alias("id"), ((F.col("seq") + F.col("seq2")) / 2).alias("seq"), F.lit(None).cast(points.schema["ref"].dataType).alias("ref"), F.col("ex").alias("x"), F.col("ey").alias("y"))
    both = points.withColumn("seq", F.col("seq").cast("double")).unionByName(fresh)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("seq"))), places.where("n <> 1").select(F.col("eid").alias("id"), "a", "b")


def keep_chains(rows: DataFrame, chain: str, inside: Column) -> DataFrame:
    """All rows of the chains of which any row is inside."""
    chosen = rows.where(inside).select(F.col(chain).alias("_chain")).distinct()
    return rows.join(chosen, F.col(chain) == F.col("_chain"), "left_semi")


def country_defaults(places: DataFrame, defaults: DataFrame, boxes: DataFrame) -> DataFrame:
    """places (id, country, lon, lat) with the climate of the first box of their country that holds them, else the country's, else null."""
    b = boxes.select(F.col("country").alias("_bc"), "ord", "west", "south", "east", "north", F.col("climate").alias("_box"))
    hit = places.join(b, (F.col("country") == F.col("_bc")) & F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    first = hit.groupBy("id").agg(F.min_by("_box", "ord").alias("_box")).withColumnRenamed("id", "_id")
    d = defaults.select(F.col("country").alias("_dc"), F.col("climate").alias("_own"))
    both = places.join(first, F.col("id") == F.col("_id"), "left").join(d, F.col("country") == F.col("_dc"), "left")
    return both.select(places.columns + [F.coalesce("_box", "_own").alias("climate"), F.when(F.col("_box").isNotNull(), "area").when(F.col("_own").isNotNull(), "country").alias("basis")])


def greedy_apart(points: DataFrame, radius: int, order: list[str], heading: tuple[str, str] | None = None, alike: float = 0.0, same: str | None = None) -> DataFrame:
    """Points (id, x, y, …) kept so that no two are within the radius, first come first served in ``order``.

    With ``heading``, the columns of a direction, only two points whose directions have an inner product of
    at least ``alike`` keep each other away, so that signs for both ways of a road may stand together; a point without direction keeps
    none away. With ``same``, a column, only points of equal value do.

    Decided in rounds over the pairs of close points: a point with no undecided earlier neighbour stays
    and its neighbours go, until no pair is undecided. That gives the same as one serial run; the number
    of rounds is the longest chain of such decisions. Equal places in the order go by id, nulls come last.
    """
    place = F.struct(*[x for c in [*order, "id"] for x in (F.col(c).isNull(), F.col(c))])
    own = points.select("id", "x", "y", place.alias("o"), *[F.col(c).alias(k) for c, k in zip(heading or (), ("hx", "hy"), strict=False)], *([F.col(same).alias("k")] if same else []))
    first = F.col("a_o") < F.col("b_o")
    close = within_distance(own, own, radius, ("k", "k") if same else None).where("a_id < b_id")
    if heading:
        close = close.where(F.col("a_hx") * F.col("b_hx") + F.col("a_hy") * F.col("b_hy") >= alike)
    pairs = _kept(close.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("early"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("late")))
    gone = []
    while not pairs.isEmpty():
        kept = pairs.select("early").distinct().join(pairs.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        lost = _kept(pairs.join(kept, "early", "left_semi").select("late").distinct())
        gone.append(lost)
        if len(gone) == 16:
            gone = [_kept(reduce(DataFrame.union, gone))]
        pairs = _kept(pairs.join(lost, "late", "left_anti").join(lost.withColumnRenamed("late", "early"), "early", "left_anti").select("early", "late"))
    return points.join(reduce(DataFrame.union, gone), F.col("id") == F.col("late"), "left_anti") if gone else points


def _bent(table: pa.Table, tolerance: float, keep: str | None) -> np.ndarray:
    """Which vertices stay of whole lines one after the other; all open stretches of all lines are split at once, a round."""
    x, y = (table[c].to_numpy().astype(float) for c in "xy")
    first = table["_first"].to_numpy()
    stay = first | np.append(first[1:], True)
    if keep:
        stay |= table[keep].fill_null(False).to_numpy()
    ends, line = np.flatnonzero(stay), np.cumsum(first)
    a, b = ends[:-1], ends[1:]
    inside = line[a] == line[b]
    a, b = a[inside], b[inside]
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            return stay
        n = b - a - 1
        off = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(a + 1 - off, n)
        dx, dy, px, py = np.repeat(x[b] - x[a], n), np.repeat(y[b] - y[a], n), x[at] - np.repeat(x[a], n), y[at] - np.repeat(y[a], n)
        size = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(size == 0, 0.0, np.clip((px * dx + py * dy) / size, 0, 1))
        d2 = (px - t * dx) ** 2 + (py - t * dy) ** 2
        most = np.maximum.reduceat(d2, off)
        far = most > tolerance * tolerance
        k = np.minimum.reduceat(np.where(d2 == np.repeat(most, n), at, len(x)), off)[far]
        stay[k] = True
        a, b = np.concatenate([a[far], k]), np.concatenate([k, b[far]])


def simplify(points: DataFrame, tolerance: float, keep: str | None = None) -> DataFrame:
    """Lines (id, seq, x, y) without vertices closer than the tolerance to the simplified line (Douglas-Peucker).

    Vertices with a true ``keep`` flag stay; the stretches between them are simplified by themselves. Lines come as a stream of
    sorted rows, a batch's whole lines together, so short lines don't cost a Python call each; a line is in one task.
    """
    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = np.flatnonzero(table["_first"].to_numpy())
            if len(starts):
                yield from kept([*held, table.slice(0, starts[-1])])
                held = []
            held.append(table.slice(starts[-1] if len(starts) else 0))
        yield from kept(held)

    def kept(parts: list[pa.Table]):
        if parts and (table := pa.concat_tables(parts)).num_rows:
            yield from table.filter(pa.array(_bent(table, tolerance, keep))).drop_columns(["_first"]).to_batches()

    order = Window.partitionBy("id").orderBy(F.asc_nulls_last("seq"))
    return points.withColumn("_first", F.row_number().over(order) == 1).mapInArrow(run, points.schema)


def assemble_rings(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings (relation, ring, seq, node) from the member ways (relation, way, nodes array) of relations, and relations (relation, fault) that don't close.

    Every end must occur exactly twice in its relation, which Spark judges, so only sound relations are joined
    end to end, by a table of their ends; a ring that meets a node twice is a fault too.
    """
    ends = segments.select("relation", F.explode(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1))).alias("node"))
    bad = ends.groupBy("relation", "node").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").select("relation").distinct()
    sound = segments.join(bad.withColumnRenamed("relation", "_bad"), F.col("relation") == F.col("_bad"), "left_anti")

    def run(table: pa.Table) -> pa.Table:
        left = dict(sorted((r["way"], r["nodes"]) for r in table.select(["way", "nodes"]).to_pylist()))
        at: dict[int, list[int]] = {}
        for way, nodes in left.items():
            for node in (nodes[0], nodes[-1]):
                at.setdefault(node, []).append(way)
        relation, out, ring = table["relation"][0].as_py(), [], 0
        for way in list(left):
            if way not in left:
                continue
            line = list(left.pop(way))
            while line[0] != line[-1]:
                part = left.pop(next(w for w in at[line[-1]] if w in left))
                line += (part if part[0] == line[-1] else part[::-1])[1:]
            out += [(relation, ring, i, n) for i, n in enumerate(line[:-1])]
            ring += 1
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["relation", "ring", "seq", "node"])

    shape = T.StructType([T.StructField("relation", T.LongType()), T.StructField("ring", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("node", T.LongType())])
    rings = _kept(sound.select("relation", "way", "nodes").groupBy("relation").applyInArrow(run, shape))
    twice = rings.groupBy("relation", "ring", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("relation").distinct()
    faults = bad.withColumn("fault", F.lit("open")).unionByName(twice.withColumn("fault", F.lit("repeated node")))
    return rings.join(twice.withColumnRenamed("relation", "_twice"), F.col("relation") == F.col("_twice"), "left_anti"), faults


def group_rings(edges: DataFrame, cell: int) -> DataFrame:
    """(id, depth, role, parent, fault): rings given as edges (id, seq, x, y, x2, y2), by how many others hold them.

    Even depths are outer rings, odd ones holes of the smallest ring around them. Rings without an area,
    and rings that cross another, are faults.
    """
    area = edges.groupBy("id").agg(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))).alias("area2"), F.min(F.struct("seq", "x", "y")).alias("p"))
    areas = area.select(F.col("id").alias("_around"), F.col("area2").alias("_area2"))
    inside = points_in_polygons(area.select("id", "p.x", "p.y"), edges, cell, boundary=False).where("id <> polygon")
    held = inside.join(areas, F.col("polygon") == F.col("_around")).groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_area2", "polygon")).alias("least"))
    pairs = crossings(edges, cell)
    crossed = pairs.select(F.col("a_id").alias("_crossed")).union(pairs.select("b_id")).distinct()
    both = area.join(held, F.col("id") == F.col("_id"), "left").join(crossed, F.col("id") == F.col("_crossed"), "left")
    depth = F.coalesce("n", F.lit(0))
    hole = depth % 2 == 1
    fault = F.when(F.col("area2") == 0, "no area").when(F.col("_crossed").isNotNull(), "crosses")
    return both.select("id", depth.alias("depth"), F.when(hole, "hole").otherwise("outer").alias("role"), F.when(hole, F.col("least.polygon")).alias("parent"), fault.alias("fault"))
