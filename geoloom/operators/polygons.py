"""Relations of ways as polygons: rings ordered by list ranking, holes in their outer rings, regions of boundaries.

Nothing here gathers a relation: the ways of a ring are put in order by pointer jumping over (end, next)
links, so a relation of a hundred thousand ways is as many rows in as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import on_segment, segments_cross
from geoloom.operators.graph import cycle_lows, stored, written
from geoloom.operators.spatial import points_in_polygons, segment_pairs

#: Tags of a member way that must agree with its relation's. Fixed values of the data model.
SHARED_TAGS = ("building", "building:part", "height", "landuse", "natural", "highway", "width", "surface")


def ring_order(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, way, size, ring, offset, backward) and open groups (group, node).

    ways are (group, way, a, b, size): open ways between end nodes, ``size`` vertices up to the last one. In a
    group every end node must occur exactly twice; groups with others are open and get no rings. A ring is named by its smallest
    way, which is walked forward and has offset 0; ``offset`` is how many vertices of the ring come before a way.

    Each way is two darts, one a direction: twice the way's number, and that plus one. A dart's successor starts where it ends, so a ring is two cycles
    of darts. ``cycle_lows`` gives every dart its distance to one dart of its cycle, from which it is turned to the smallest way.
    """
    own = written(ways.select("group", "way", "a", "b", F.col("size").cast("long").alias("size")).withColumn("num", F.monotonically_increasing_id()))
    ports = own.select("group", "num", "size", F.posexplode(F.array("a", "b")).alias("side", "node")).select("group", "node", "size", (F.col("num") * 2 + F.col("side")).alias("port"))
    sizes = [F.min_by("size", "port").alias("p_size"), F.max_by("size", "port").alias("q_size")]
    ends = written(ports.groupBy("group", "node").agg(F.count(F.lit(1)).alias("n"), F.min("port").alias("p"), F.max("port").alias("q"), *sizes))
    open_ = ends.where("n <> 2").select("group", "node")
    bad = open_.select(F.col("group").alias("_bad")).distinct()
    sound = ends.where("n = 2").join(bad, F.col("group") == F.col("_bad"), "left_anti")
    # who leaves through one port enters through the other: dart side 0 runs from a to b, side 1 back
    step = lambda out, into: F.struct(F.col(out).bitwiseXOR(F.lit(1).cast("long")).alias("dart"), F.col(into).alias("next"), F.col(f"{out}_size").alias("dist"))
    links = written(sound.select(F.explode(F.array(step("p", "q"), step("q", "p"))).alias("s")).select("s.*"))
    found = cycle_lows(links).select("low", "dist", F.shiftright("dart", 1).alias("_num"), (F.col("dart") % 2).alias("side"))
    at = stored(found.join(own, F.col("_num") == F.col("num")).select("group", "way", "size", "side", "low", "dist"))
    rings = at.groupBy(F.col("low").alias("_low")).agg(F.min("way").alias("ring"), F.min_by("side", "way").alias("_side"), F.min_by("dist", "way").alias("_dist"), F.sum("size").alias("_all"))
    # of a ring's two cycles the one that walks its smallest way forward
    one = at.join(written(rings.where("_side = 0").drop("_side")), F.col("low") == F.col("_low"))
    return one.select("group", "way", "size", "ring", F.pmod(F.col("_dist") - F.col("dist"), F.col("_all")).alias("offset"), (F.col("side") == 1).alias("backward")), open_


def ring_vertices(members: DataFrame, way_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings (group, ring, seq, node) of the ways (group, way) of each group, and faults (group, fault).

    way_nodes are (id, seq, ref) with seq from 1. Closed ways are rings of their own. Rings start at their smallest node
    and go on to the smaller of its neighbours. Faults, which cost the group all its rings: ``open`` (an end that isn't shared by exactly two ways),
    ``short`` (a way of one node or a ring of less than three), ``repeated node`` (in a ring).
    """
    used = written(way_nodes.join(members.select(F.col("way").alias("_used")).distinct(), F.col("id") == F.col("_used"), "left_semi").select("id", "seq", "ref"))
    shape = used.groupBy(F.col("id").alias("_id")).agg(F.min_by("ref", "seq").alias("a"), F.max_by("ref", "seq").alias("b"), (F.count(F.lit(1)) - 1).alias("size"))
    ways = written(members.select("group", "way").join(shape, F.col("way") == F.col("_id")).drop("_id"))
    closed, ends = ways.where("a = b AND size > 0"), ways.where("a <> b")
    order, open_ = ring_order(ends)
    placed = order.unionByName(closed.select("group", "way", "size", F.col("way").alias("ring"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("backward")))
    at = placed.join(used, F.col("way") == F.col("id"))
    step = F.when(F.col("backward"), F.col("size") + 1 - F.col("seq")).otherwise(F.col("seq") - 1)
    walked = stored(at.where(step < F.col("size")).select("group", "ring", (F.col("offset") + step).alias("seq"), F.col("ref").alias("node")))
    rings = written(walked.groupBy("group", "ring").agg(F.count(F.lit(1)).alias("n"), F.min_by("seq", "node").alias("_s")))
    twice = walked.groupBy("group", "ring", "node").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    faults = [open_.select("group", F.lit("open").alias("fault")), ways.where("size < 1").select("group", F.lit("short").alias("fault")), rings.where("n < 3").select("group", F.lit("short").alias("fault")), twice.select("group", F.lit("repeated node").alias("fault"))]
    fault = written(faults[0].union(faults[1]).union(faults[2]).union(faults[3]).distinct())
    bad = fault.select(F.col("group").alias("_bad")).distinct()
    # rings are few or small: what is known of a ring goes to its vertices, not all of a ring's vertices to one task
    same = (F.col("group") == F.col("_g")) & (F.col("ring") == F.col("_r"))
    start = written(rings.join(bad, F.col("group") == F.col("_bad"), "left_anti").select(F.col("group").alias("_g"), F.col("ring").alias("_r"), "n", "_s"))
    turned = walked.join(start, same).withColumn("seq", F.pmod(F.col("seq") - F.col("_s"), F.col("n")))
    sides = turned.where("seq = 1 OR seq = n - 1").groupBy("_g", "_r", "n", "_s").agg((F.min_by("node", "seq") > F.max_by("node", "seq")).alias("_turn"))
    seq = F.pmod(F.col("seq") - F.col("_s"), F.col("n"))
    final = walked.join(written(sides), same)
    return final.select("group", "ring", F.when(F.col("_turn"), F.pmod(-seq, F.col("n"))).otherwise(seq).alias("seq"), "node"), fault


def ring_edges(rings: DataFrame, *keys: str) -> DataFrame:
    """Rings' vertices (keys, seq, x, y) as edges with x2, y2 and ``n``, the ring's size; by a join, so no ring is one window."""
    sizes = rings.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: [F.col(x) == F.col(y) for x, y in zip(a, b, strict=True)]
    marks = [f"_{k}" for k in keys]
    sized = rings.join(sizes, _all(same(keys, marks))).drop(*marks)
    ahead = sized.select(*[F.col(k).alias(f"_{k}") for k in keys], F.pmod(F.col("seq") - 1, F.col("n")).alias("_seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return sized.join(ahead, _all(same((*keys, "seq"), (*marks, "_seq")))).drop(*marks, "_seq")


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def ring_contacts(edges: DataFrame, cell: int) -> DataFrame:
    """(group): where edges (group, ring, seq, n, x, y, x2, y2) of a group meet otherwise than as neighbours in a ring.

    Crossing and touching count, also of one ring with itself, and an edge that goes back over its neighbour.
    """
    pairs = segment_pairs(edges, edges, cell, "group").where("a_ring < b_ring OR (a_ring = b_ring AND a_seq < b_seq)")
    a, b = ([F.col(f"{p}_{c}") for c in ("x", "y", "x2", "y2")] for p in "ab")
    meet = segments_cross(*a, *b) | on_segment(*a[:2], *b) | on_segment(*a[2:], *b) | on_segment(*b[:2], *a) | on_segment(*b[2:], *a)
    follows = F.col("b_seq") - F.col("a_seq") == 1
    joined = (F.col("a_ring") == F.col("b_ring")) & (follows | ((F.col("a_seq") == 0) & (F.col("b_seq") == F.col("a_n") - 1)))
    back = F.when(follows, on_segment(*b[2:], *a) | on_segment(*a[:2], *b)).otherwise(on_segment(*b[:2], *a) | on_segment(*a[2:], *b))
    return pairs.where(F.when(joined, back).otherwise(meet)).select(F.col("a_group").alias("group")).distinct()


def nest_rings(edges: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """(group, ring, role, parent) and faults (group, fault) of rings given as edges with their role (outer, inner).

    An inner ring lies in the smallest ring around it, which must be an outer one; an outer ring may lie only in an inner one. Groups
    are judged alone, so polygons of different groups may overlap. Faults: ``no outer ring``, ``no area``,
    ``rings meet``, ``outer areas overlap``, ``hole outside``.
    """
    twice = F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")))
    rings = written(edges.groupBy("group", "ring", "role").agg(twice.alias("area2"), F.min(F.struct("seq", "x", "y")).alias("p")))
    key = F.struct("group", "ring")
    points = rings.select(key.alias("id"), "group", "p.x", "p.y")
    around = points_in_polygons(points, edges.select(key.alias("id"), "group", "x", "y", "x2", "y2"), cell, boundary=False, same="group").where("id <> polygon")
    known = rings.select(key.alias("_k"), F.col("area2").alias("_area2"), F.col("role").alias("_role"))
    parent = around.join(known, F.col("polygon") == F.col("_k")).groupBy("id").agg(F.min(F.struct("_area2", F.col("polygon.ring").alias("ring"), "_role")).alias("m"))
    placed = written(rings.join(parent, (F.col("group") == F.col("id.group")) & (F.col("ring") == F.col("id.ring")), "left").select("group", "ring", "role", "area2", F.col("m.ring").alias("parent"), F.col("m._role").alias("parent_role")))
    meet = written(ring_contacts(edges, cell))
    clear = placed.join(meet.withColumnRenamed("group", "_meet"), F.col("group") == F.col("_meet"), "left_anti")  # where rings meet, one vertex doesn't tell
    parts = [
        placed.groupBy("group").agg(F.max((F.col("role") == "outer").cast("int")).alias("_o")).where("_o = 0").select("group", F.lit("no outer ring").alias("fault")),
        placed.where("area2 = 0").select("group", F.lit("no area").alias("fault")),
        meet.withColumn("fault", F.lit("rings meet")),
        clear.where("role = 'outer' AND parent_role = 'outer'").select("group", F.lit("outer areas overlap").alias("fault")),
        clear.where("role = 'inner' AND (parent IS NULL OR parent_role = 'inner')").select("group", F.lit("hole outside").alias("fault")),
    ]
    faults = parts[0]
    for p in parts[1:]:
        faults = faults.unionByName(p)
    faults = written(faults.distinct())
    sound = placed.join(faults.select(F.col("group").alias("_bad")).distinct(), F.col("group") == F.col("_bad"), "left_anti")
    return sound.select("group", "ring", "role", F.when(F.col("role") == "inner", F.col("parent")).alias("parent")), faults


def member_faults(members: DataFrame, ways: DataFrame, missing_nodes: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(relation, fault) of members (relation, pos, type, ref, role, tags of the relation) that can't form polygons.

    ways are (id, tags map, kind: what the way is by itself, or null). A way that several relations list belongs to the smallest of
    them; the others are faulty, as are those with members that aren't ways with the role outer or inner, listed twice, blocked,
    missing, without some node, or with tags that conflict.
    """
    way = ways.select(F.col("id").alias("_way"), F.col("tags").alias("_tags"), "kind")
    lacking = missing_nodes.select(F.col("id").alias("_lacks")).distinct()
    owner = members.groupBy(F.col("ref").alias("_ref")).agg(F.min("relation").alias("_owner"))
    times = members.groupBy(F.col("relation").alias("_rel"), F.col("ref").alias("_r")).agg(F.count(F.lit(1)).alias("_times"))
    both = members.join(way, F.col("ref") == F.col("_way"), "left").join(lacking, F.col("ref") == F.col("_lacks"), "left")
    both = both.join(owner, F.col("ref") == F.col("_ref"), "left").join(times, (F.col("relation") == F.col("_rel")) & (F.col("ref") == F.col("_r")), "left")
    stopped = F.lit(False)
    if blocked is not None:
        both = both.join(blocked.select(F.col("id").alias("_blocked")).distinct(), F.col("ref") == F.col("_blocked"), "left")
        stopped = F.col("_blocked").isNotNull()
    own = lambda k: F.col("_tags").getItem(k)
    conflict = F.lit(False)
    for k in SHARED_TAGS:
        conflict = conflict | (own(k).isNotNull() & ~own(k).eqNullSafe(F.col("tags").getItem(k)))
    checks = [
        ((F.col("type") != "way") | ~F.coalesce(F.col("role"), F.lit("")).isin("outer", "inner"), "member kind"),
        (F.col("_times") > 1, "repeated member"),
        (stopped, "blocked member"),
        (F.col("_owner") < F.col("relation"), "shared member"),
        (F.col("_way").isNull(), "missing way"),
        (F.col("_lacks").isNotNull(), "missing node"),
        (conflict | ((F.col("role") == "inner") & F.col("kind").isNotNull()), "conflicting tags"),
    ]
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return both.select("relation", F.explode(named).alias("fault")).distinct()


def relation_polygons(members: DataFrame, ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame, cell: int, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations as multipolygons: vertices (relation, role, ring, parent, seq, node, x, y), faults (relation, fault), consumed ways (way, relation).

    members are (relation, pos, type, ref, role, tags); ways (id, tags, kind); way_nodes (id, seq, ref); nodes (id, x, y). A relation with a fault gives
    no polygon and consumes nothing; faults name all that is wrong at the step that failed.
    """
    known = nodes.select(F.col("id").alias("_node"), "x", "y")
    lacking = way_nodes.join(known, F.col("ref") == F.col("_node"), "left_anti").select("id")
    first = written(member_faults(members, ways, lacking, blocked))
    sound = written(members.join(first.select(F.col("relation").alias("_bad")).distinct(), F.col("relation") == F.col("_bad"), "left_anti"))
    grouped = sound.select(F.struct("relation", "role").alias("group"), F.col("ref").alias("way"))
    rings, second = ring_vertices(grouped, way_nodes)
    second = written(second.select(F.col("group.relation").alias("relation"), "fault").distinct())
    whole = rings.join(second.select(F.col("relation").alias("_bad")).distinct(), F.col("group.relation") == F.col("_bad"), "left_anti")
    located = whole.join(known, F.col("node") == F.col("_node")).select(F.col("group.relation").alias("group"), F.col("group.role").alias("role"), "ring", "seq", "node", "x", "y")
    located = written(located)
    placed, third = nest_rings(ring_edges(located, "group", "role", "ring"), cell)
    at = placed.select(F.col("group").alias("_g"), F.col("ring").alias("_r"), "parent")
    final = located.join(at, (F.col("group") == F.col("_g")) & (F.col("ring") == F.col("_r"))).select(F.col("group").alias("relation"), "role", "ring", "parent", "seq", "node", "x", "y")
    faults = first.unionByName(second).unionByName(third.select(F.col("group").alias("relation"), "fault"))
    consumed = sound.join(placed.select(F.col("group").alias("_g")).distinct(), F.col("relation") == F.col("_g"), "left_semi").select(F.col("ref").alias("way"), "relation")
    return final, faults, consumed


def boundary_edges(members: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Administrative relations as the edges of their rings (id, x, y, x2, y2), ready for ``points_in_polygons``, and faults (relation, fault).

    Members are (relation, type, ref, role); an empty role counts as outer, other roles than outer and inner don't count. Nothing is guessed: a boundary
    with a nested relation (``nested``), a way or node that is missing (``incomplete``) or an end that stays open is refused. Inner rings cut their outer
    ones by parity; the union of several relations is the set of their edges, and a point is in it if it is in any.
    """
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", "outer").otherwise(F.col("role"))
    used = written(members.withColumn("role", role).where("role IN ('outer', 'inner')").select("relation", "type", "ref", "role").distinct())
    known = nodes.select(F.col("id").alias("_node"), "x", "y")
    nested = used.where("type <> 'way'").select("relation", F.lit("nested").alias("fault"))
    lines = way_nodes.select(F.col("id").alias("_way")).distinct()
    lacking = way_nodes.join(known, F.col("ref") == F.col("_node"), "left_anti").select(F.col("id").alias("_way")).distinct()
    gone = used.where("type = 'way'").join(lines, F.col("ref") == F.col("_way"), "left_anti").select("relation")
    gone = gone.union(used.join(lacking, F.col("ref") == F.col("_way"), "left_semi").select("relation")).withColumn("fault", F.lit("incomplete"))
    first = written(nested.unionByName(gone).distinct())
    sound = used.join(first.select(F.col("relation").alias("_bad")).distinct(), F.col("relation") == F.col("_bad"), "left_anti")
    rings, second = ring_vertices(sound.select(F.struct("relation", "role").alias("group"), F.col("ref").alias("way")), way_nodes)
    second = written(second.select(F.col("group.relation").alias("relation"), "fault").distinct())
    whole = rings.join(second.select(F.col("relation").alias("_bad")).distinct(), F.col("group.relation") == F.col("_bad"), "left_anti")
    located = whole.join(known, F.col("node") == F.col("_node")).select(F.col("group.relation").alias("id"), F.col("group.role").alias("role"), "ring", "seq", "x", "y")
    return ring_edges(written(located), "id", "role", "ring").select("id", "x", "y", "x2", "y2"), first.unionByName(second)


def in_region(points: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """Points (id, x, y) in the union of the polygons."""
    hit = points_in_polygons(points, edges, cell).select(F.col("id").alias("_in")).distinct()
    return points.join(hit, F.col("id") == F.col("_in"), "left_semi")
