"""Fusion of auxiliary buildings into a map, whole and cell by cell, and footprints against road space.

Footprints are boxes (id, x0, y0, x1, y1) in whole centimetres. A run of the fusion can be repeated for what changed alone: the inputs'
records leave a signature for each cell they touch, for each source id and for each kind of building, and only
footprints that depend on a changed signature are judged again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import clip_interval, point_segment_distance2
from geoloom.operators.aggregates import cell_signatures
from geoloom.operators.fusion import overlaps
from geoloom.operators.graph import written
from geoloom.operators.spatial import box_join, boxed_segments, occupancy, within_distance

#: Neighbours within this many centimetres lend their median height; a storey's metres; spare room over and under a structure. Fixed values.
NEIGHBOURS, STOREY, ROOM = 6000, 3.0, 0.5


def road_conflicts(buildings: DataFrame, segs: DataFrame, cell: int, scale: float = 1.0) -> DataFrame:
    """(id, road, seq): pieces of roads that cut a building's footprint.

    buildings are (id, x0, y0, x1, y1, base, top); segs (road, seq, x, y, x2, y2, z, z2, width, kind: ground, bridge or tunnel), z being a bridge's
    deck or a tunnel's ceiling. A piece overlaps a footprint that is nearer than half its width. A bridge whose lowest deck over the footprint is ``ROOM`` above its top, and
    a tunnel whose highest ceiling is as far below its base, clear it. A road is all or nothing: if one of its pieces conflicts with a building, all its
    pieces that overlap this building cut it, also those that would clear it by themselves.
    """
    half = F.col("b_width") / 2.0
    most = segs.agg(F.max("width")).first()[0] or 0
    named = segs.withColumnRenamed("road", "id")
    # written, so that the long exact conditions are not part of the join's, and run once for pairs whose boxes are near
    needed = [f"a_{c}" for c in (*BOX, "base", "top")] + [f"b_{c}" for c in ("id", "seq", "x", "y", "x2", "y2", "z", "z2", "width", "kind")]
    pairs = written(box_join(buildings, boxed_segments(named), cell, int(most / 2) + 1).select(*needed))
    box = {c: F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")}
    line = [F.col(f"b_{c}") for c in ("x", "y", "x2", "y2")]
    # columns of a projection share their common parts, a filter's conditions don't
    t0, t1 = clip_interval(*line, box["x0"] - half, box["y0"] - half, box["x1"] + half, box["y1"] + half)
    near = pairs.select("a_id", "a_base", "a_top", "b_id", "b_seq", "b_kind", "b_z", "b_z2", F.coalesce(t0, F.lit(0.0)).alias("t0"), F.coalesce(t1, F.lit(1.0)).alias("t1"), (_gap2(line, box) < half * half).alias("near"))
    at = [F.col("b_z") + (F.col("b_z2") - F.col("b_z")) * F.col(t) for t in ("t0", "t1")]
    clear = F.when(F.col("b_kind") == "bridge", F.least(*at) >= F.col("a_top") + ROOM * scale).when(F.col("b_kind") == "tunnel", F.greatest(*at) + ROOM * scale <= F.col("a_base"))
    judged = written(near.select(F.col("a_id").alias("id"), F.col("b_id").alias("road"), F.col("b_seq").alias("seq"), F.coalesce(clear, F.lit(False)).alias("clear"), "near")).where("near")
    hit = judged.where("NOT clear").select(F.col("id").alias("_id"), F.col("road").alias("_road")).distinct()
    return judged.join(hit, (F.col("id") == F.col("_id")) & (F.col("road") == F.col("_road")), "left_semi").select("id", "road", "seq")


def _gap2(line: list[Column], box: dict[str, Column]) -> Column:
    """Squared distance of a segment from a box: from the box's corners to it or from its ends to the box, 0 if a part of it lies inside."""
    t0, _ = clip_interval(*line, *[box[c] for c in ("x0", "y0", "x1", "y1")])
    corners = [point_segment_distance2(box[x], box[y], *line) for x in ("x0", "x1") for y in ("y0", "y1")]
    zero = F.lit(0).cast("long")
    ends = [F.pow(F.greatest(box["x0"] - x, zero, x - box["x1"]), 2) + F.pow(F.greatest(box["y0"] - y, zero, y - box["y1"]), 2) for x, y in (line[:2], line[2:])]
    return F.when(t0.isNotNull(), 0.0).otherwise(F.least(*corners, *ends))


@dataclass
class Sources:
    """base (id, box, h, source), auxiliary (id, box, h, floors, kind, underground, source), segs as for ``road_conflicts``, profiles (kind, height)."""

    base: DataFrame
    auxiliary: DataFrame
    segs: DataFrame
    profiles: DataFrame


BOX = ("id", "x0", "y0", "x1", "y1")


def _earlier_win(pairs: DataFrame) -> DataFrame:
    """(late): who gives way when of each pair (early, late) the early one stands, unless it gives way itself.

    In rounds: who is in no undecided pair as the late one stands, and those paired with it give way.
    """
    gone = []
    pairs = written(pairs)
    while not pairs.isEmpty():
        stands = pairs.select("early").distinct().join(pairs.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        lost = written(pairs.join(stands, "early", "left_semi").select("late").distinct())
        gone.append(lost)
        pairs = written(pairs.join(lost, "late", "left_anti").join(lost.withColumnRenamed("late", "early"), "early", "left_anti").select("early", "late"))
    return reduce(DataFrame.union, gone) if gone else pairs.select("late")


def _heights(rows: DataFrame, base: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, height, basis): own height, else floors, else the median of three or more neighbours, else the profile of its kind."""
    middle = lambda df: df.select("id", ((F.col("x0") + F.col("x1")) / 2).cast("long").alias("x"), ((F.col("y0") + F.col("y1")) / 2).cast("long").alias("y"), "h")
    bare = rows.where("coalesce(h, floors, 0) = 0")
    near = within_distance(middle(bare), middle(base.where("h IS NOT NULL")), NEIGHBOURS)
    lent = near.groupBy(F.col("a_id").alias("_id")).agg(F.when(F.count(F.lit(1)) >= 3, F.median("b_h")).alias("_median"))
    both = rows.join(lent, F.col("id") == F.col("_id"), "left").join(profiles.select(F.col("kind").alias("_kind"), F.col("height").alias("_profile")), F.col("kind") == F.col("_kind"), "left")
    steps = [(F.col("h") > 0, F.col("h"), "auxiliary:height"), (F.col("floors") > 0, F.col("floors") * STOREY, "auxiliary:floors"), (F.col("_median").isNotNull(), F.col("_median"), "context:neighbour_median")]
    height, basis = F.when(steps[0][0], steps[0][1]), F.when(steps[0][0], steps[0][2])
    for test, value, name in steps[1:]:
        height, basis = height.when(test, value), basis.when(test, F.lit(name))
    return both.select("id", height.otherwise(F.col("_profile")).cast("double").alias("height"), basis.otherwise("context:profile").alias("basis"))


def fuse_sources(s: Sources, cell: int, standing: DataFrame | None = None) -> DataFrame:
    """(id, verdict, height, basis) for each auxiliary footprint.

    The map owns conflicts. A footprint is, in this order: ``underground``; ``duplicate id`` (a base record has its source id); ``duplicate overlap`` (half of the
    union with a base footprint is common); ``conflict`` (it overlaps a base footprint, or an added one of a smaller id); ``road conflict``; else
    ``added``, with its height and where it comes from. ``standing`` are footprints (box) added before, of whatever id.
    """
    aux = s.auxiliary
    ids = s.base.where("source IS NOT NULL").select(F.col("source").alias("_source")).distinct()
    met = overlaps(aux.select(*BOX), s.base.select(*BOX), cell).groupBy(F.col("a_id").alias("_m")).agg(F.max("iou").alias("_iou"))
    first = aux.join(ids, F.col("source") == F.col("_source"), "left").join(met, F.col("id") == F.col("_m"), "left")
    verdict = F.when(F.coalesce("underground", F.lit(False)), "underground").when(F.col("_source").isNotNull(), "duplicate id").when(F.col("_iou") >= 0.5, "duplicate overlap").when(F.col("_iou").isNotNull(), "conflict")
    judged = written(first.select(*aux.columns, verdict.alias("verdict")))
    free = judged.where("verdict IS NULL").drop("verdict")
    heights = written(_heights(free, s.base, s.profiles))
    tall = free.join(heights.select(F.col("id").alias("_h"), "height"), F.col("id") == F.col("_h")).select(*BOX, F.lit(0.0).alias("base"), F.coalesce("height", F.lit(0.0)).alias("top"))
    blocked = written(road_conflicts(tall, s.segs, cell).select(F.col("id").alias("_road")).distinct())
    able = free.join(blocked, F.col("id") == F.col("_road"), "left_anti").select(*BOX)
    before = free.select("id").limit(0)
    if standing is not None:
        before = overlaps(free.select(*BOX), standing.select(*BOX), cell).where("b_id < a_id").select(F.col("a_id").alias("id")).distinct()
    open_ = written(able.join(before.withColumnRenamed("id", "_b"), F.col("id") == F.col("_b"), "left_anti"))
    pairs = overlaps(open_, open_, cell).where("a_id < b_id").select(F.col("a_id").alias("early"), F.col("b_id").alias("late"))
    lost = _earlier_win(pairs)
    added = written(open_.join(lost, F.col("id") == F.col("late"), "left_anti"))
    # one that a road blocks is named after the added footprint that it overlaps, if there is one before it
    shadowed = overlaps(free.select(*BOX), added, cell).where("b_id < a_id").select(F.col("a_id").alias("id")).union(before).distinct().withColumnRenamed("id", "_shadow")
    final = judged.join(added.select(F.col("id").alias("_added")), F.col("id") == F.col("_added"), "left").join(shadowed, F.col("id") == F.col("_shadow"), "left")
    final = final.join(heights.withColumnRenamed("id", "_h"), F.col("id") == F.col("_h"), "left")
    stands = F.col("_added").isNotNull()
    reason = F.coalesce("verdict", F.when(stands, "added").when(F.col("_shadow").isNotNull(), "conflict").otherwise("road conflict"))
    return final.select("id", reason.alias("verdict"), F.when(stands, F.col("height")).alias("height"), F.when(stands, F.col("basis")).alias("basis"))


def signatures(s: Sources, cell: int) -> DataFrame:
    """(space, cx, cy, signature) of all that a verdict can depend on: cells of the map, source ids of the base, and the profile of each kind."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("record", F.concat_ws("|", F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in sorted(df.columns)]))

    lines = boxed_segments(s.segs)
    reach = F.ceil(F.col("width") / 2.0).cast("long")
    wide = lines.withColumns({"x0": F.col("x0") - reach, "y0": F.col("y0") - reach, "x1": F.col("x1") + reach, "y1": F.col("y1") + reach})
    on_map = [occupancy(hashed(df, name), cell).select("cx", "cy", "record") for name, df in (("base", s.base), ("auxiliary", s.auxiliary), ("segs", wide))]
    spaces = [
        ("map", on_map[0].unionByName(on_map[1]).unionByName(on_map[2])),
        ("source", s.base.where("source IS NOT NULL").select(F.xxhash64("source").alias("cx"), F.lit(0).cast("long").alias("cy"), "source").distinct().withColumnRenamed("source", "record")),
        ("profile", hashed(s.profiles, "profile").select(F.xxhash64("kind").alias("cx"), F.lit(0).cast("long").alias("cy"), "record")),
    ]
    parts = [cell_signatures(df).select(F.lit(name).alias("space"), "cx", "cy", "signature") for name, df in spaces]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """(space, cx, cy) whose signature differs, appeared or went."""
    keys = ["space", "cx", "cy"]
    return before.withColumnRenamed("signature", "_old").join(after, keys, "full").where(~F.col("_old").eqNullSafe(F.col("signature"))).select(*keys)


def affected(s: Sources, changed: DataFrame, previous: DataFrame, cell: int) -> DataFrame:
    """(id): auxiliary footprints whose verdict may differ from the previous run's.

    They are new, lie within a neighbour's reach of a changed cell, or depend on a changed source id or the changed profile of their kind; and, since an added
    footprint outdoes later ones, so do those of larger ids that overlap one of them, and so on along the chain.
    """
    def at(space: str) -> DataFrame:
        return changed.where(F.col("space") == space).select(F.col("cx").alias("_x"), F.col("cy").alias("_y"))

    aux = s.auxiliary
    near = occupancy(aux.select(*BOX), cell, NEIGHBOURS).join(at("map"), (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")), "left_semi").select("id")
    by = [aux.join(at(space), F.xxhash64(column) == F.col("_x"), "left_semi").select("id") for space, column in (("source", "source"), ("profile", "kind"))]
    new = aux.select("id").join(previous.select(F.col("id").alias("_p")), F.col("id") == F.col("_p"), "left_anti")
    found = written(near.union(by[0]).union(by[1]).union(new).distinct())
    front, all_of = found, [found]
    while not front.isEmpty():
        own = aux.join(front.withColumnRenamed("id", "_f"), F.col("id") == F.col("_f"), "left_semi").select(*BOX)
        after = overlaps(own, aux.select(*BOX), cell).where("a_id < b_id").select(F.col("b_id").alias("id")).distinct()
        known = reduce(DataFrame.union, all_of).withColumnRenamed("id", "_k")
        front = written(after.join(known, F.col("id") == F.col("_k"), "left_anti"))
        all_of.append(front)
    return reduce(DataFrame.union, all_of)


def refuse_changed(s: Sources, changed: DataFrame, previous: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """The fusion of the sources from the previous run's result and the changed cells: the whole result, and the ids (id) that were judged again.

    Only base records and roads in the cells near these footprints take part.
    """
    again = written(affected(s, changed, previous, cell))
    names = again.withColumnRenamed("id", "_a")
    part = written(s.auxiliary.join(names, F.col("id") == F.col("_a"), "left_semi"))
    near = written(occupancy(part.select(*BOX), cell, NEIGHBOURS).select(F.col("cx").alias("_x"), F.col("cy").alias("_y")).distinct())
    here = (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y"))
    own_source = part.where("source IS NOT NULL").select(F.col("source").alias("_s")).distinct()
    around = occupancy(s.base, cell).join(near, here, "left_semi").drop("cx", "cy")
    base = around.unionByName(s.base.join(own_source, F.col("source") == F.col("_s"), "left_semi")).dropDuplicates(["id"])
    lines = boxed_segments(s.segs)
    segs = occupancy(lines, cell, int((s.segs.agg(F.max("width")).first()[0] or 0) / 2) + 1).join(near, here, "left_semi").select(*s.segs.columns).dropDuplicates(["road", "seq"])
    rest = previous.join(names, F.col("id") == F.col("_a"), "left_anti").join(s.auxiliary.select(F.col("id").alias("_now")), F.col("id") == F.col("_now"), "left_semi")
    kept = s.auxiliary.join(rest.where("verdict = 'added'").select(F.col("id").alias("_k")), F.col("id") == F.col("_k"), "left_semi")
    standing = occupancy(kept.select(*BOX), cell).join(near, here, "left_semi").select(*BOX).dropDuplicates(["id"])
    fresh = fuse_sources(Sources(base, part, segs, s.profiles), cell, standing)
    return rest.unionByName(fresh), again


def report(result: DataFrame) -> DataFrame:
    """(verdict, basis, n): how many footprints came to what, and where the heights of the added ones come from."""
    return result.groupBy("verdict", "basis").agg(F.count(F.lit(1)).alias("n"))
