"""Opposite carriageways as ladders: chains in travel direction, rungs between two of them, cells that may merge.

Roads are (id, a, b, kind, segments): one-way lines from node ``a`` to node ``b``, their segments (id, seq, x, y, x2, y2) in the
direction of travel. Lengths are in the units of the coordinates. Steps are joins by node, by grid cell and by place along a
chain; no chain is compared with all of another.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import point_segment_distance2
from geoloom.operators.graph import written
from geoloom.operators.parallels import ahead, beside, match_carriageways, with_places
from geoloom.operators.sequences import segment_length
from geoloom.operators.spatial import ACROSS, box_join, boxed_points, boxed_segments, in_named_polygons, once, points_in_polygons, polygon_boxes

#: Share of both sides that must be matched, longest rung in separations, least merge, least slack along the road for
#: opposite nodes, cosine of the sharpest turn inside a chain, and what another road may run inside a cell. Fixed values.
OVERLAP = 0.7
RUNG = 3.0
LEAST_MERGE = 50.0
ALIGN = 10.0
TURN = 0.7071067811865476
INSIDE = 2.0
#: Share of a link's samples that lie in a cell if it belongs to the cell.
BELONGS = 0.8


def ranked(links: DataFrame) -> DataFrame:
    """(id, first, rank) of lists (id, prev; null at the start), by doubling the pointers; rows of a cycle are left out.

    As long as a row outside the cycles has a pointer left, each round ends one more, so a round that ends none leaves cycles only.
    """
    at = written(links.select("id", "prev", F.coalesce("prev", "id").alias("first"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("rank")))
    open_ = at.where("prev IS NOT NULL").count()
    while open_:
        there = at.select(F.col("id").alias("_id"), F.col("prev").alias("_prev"), F.col("first").alias("_first"), F.col("rank").alias("_rank"))
        met = at.join(there, F.col("prev") == F.col("_id"), "left")
        at = written(met.select("id", F.col("_prev").alias("prev"), F.coalesce("_first", "first").alias("first"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank")))
        left = at.where("prev IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    return at.where("prev IS NULL").select("id", "first", "rank")


def travel_chains(roads: DataFrame, segs: DataFrame) -> DataFrame:
    """(id, chain, rank): roads that follow each other without a choice, with ``chain`` the first road's id and ``rank`` from 0.

    A road follows another if it starts where that ends, is of its kind and turns by less than 45 degrees, and if it is the only one that
    does so and follows no other in the same way. Cycles and chains that meet a node twice are left out.
    """
    d = [F.col("x2") - F.col("x"), F.col("y2") - F.col("y")]
    unit = F.struct(*[(c / segment_length()).alias(n) for c, n in zip(d, ("hx", "hy"), strict=True)])
    heads = segs.where("x <> x2 OR y <> y2").groupBy(F.col("id").alias("_h")).agg(F.min_by(unit, "seq").alias("out"), F.max_by(unit, "seq").alias("into"))
    own = written(roads.select("id", "a", "b", "kind").join(heads, F.col("id") == F.col("_h")).drop("_h"))
    after = own.select(F.col("id").alias("next"), F.col("a").alias("_a"), F.col("kind").alias("_kind"), F.col("out").alias("_out"))
    both = own.join(after, (F.col("b") == F.col("_a")) & F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("id") != F.col("next")))
    both = both.where(F.col("into.hx") * F.col("_out.hx") + F.col("into.hy") * F.col("_out.hy") > TURN)
    only = both.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next")).where("n = 1")
    prev = only.groupBy("next").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("prev")).where("n = 1").select(F.col("next").alias("_next"), "prev")
    order = ranked(own.select("id").join(prev, F.col("id") == F.col("_next"), "left").select("id", "prev"))
    placed = written(own.select("id", "a", "b").join(order.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id"))
    nodes = placed.select("first", F.col("b").alias("node")).union(placed.where("rank = 0").select("first", "a"))
    twice = nodes.groupBy("first", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("first").alias("_bad")).distinct()
    return placed.join(twice, F.col("first") == F.col("_bad"), "left_anti").select("id", F.col("first").alias("chain"), "rank")


def _along(roads: DataFrame, segs: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains' segments (chain, rank, id, seq, …, at: length of the chain before them) and nodes (chain, k, node, x, y, at)."""
    own = segs.join(chains.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id").withColumn("len", segment_length())
    order = Window.partitionBy("chain").orderBy("rank", "seq")
    before = F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lines = written(own.select("chain", "rank", "id", "seq", "x", "y", "x2", "y2", "len", before.alias("at")))
    edge = lines.groupBy("chain", "rank", "id").agg(F.min(F.struct("seq", "x", "y", "at")).alias("s"), F.max(F.struct("seq", "x2", "y2", (F.col("at") + F.col("len")).alias("at"))).alias("e"))
    named = edge.join(roads.select(F.col("id").alias("_id"), "a", "b"), F.col("id") == F.col("_id"))
    last = named.groupBy("chain").agg(F.max(F.struct("rank", "b", "e")).alias("l"))
    starts = named.select("chain", F.col("rank").alias("k"), F.col("a").alias("node"), "s.x", "s.y", "s.at")
    ends = last.select("chain", (F.col("l.rank") + 1).alias("k"), F.col("l.b").alias("node"), F.col("l.e.x2").alias("x"), F.col("l.e.y2").alias("y"), F.col("l.e.at").alias("at"))
    return lines, written(starts.unionByName(ends))


def _opposite(nodes: DataFrame, lines: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """(pair, k, sep, at): how far a pair's nodes of the first chain are from the second one, within reach, and where along it."""
    points = nodes.join(pairs, F.col("chain") == F.col("pair.a")).select("pair", "k", "x", "y")
    sides = lines.join(pairs, F.col("chain") == F.col("pair.b")).select("pair", "x", "y", "x2", "y2", "at", "len").where("len > 0")
    near = box_join(boxed_points(points), boxed_segments(sides), max(1, reach), reach, ("pair", "pair"))
    c = [F.col(n).cast("double") for n in ("a_x", "a_y", "b_x", "b_y", "b_x2", "b_y2")]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c[0] - c[2]) * (c[4] - c[2]) + (c[1] - c[3]) * (c[5] - c[3])) / (F.col("b_len") * F.col("b_len"))))
    near = once(near, gap=F.sqrt(point_segment_distance2(*c))).where(F.col("gap") <= reach)
    best = near.groupBy(F.col("a_pair").alias("pair"), F.col("a_k").alias("k")).agg(F.min(F.struct(F.col("gap").alias("sep"), (F.col("b_at") + t * F.col("b_len")).alias("at"))).alias("m"))
    return best.select("pair", "k", "m.sep", "m.at")


def rungs(nodes: DataFrame, lines: DataFrame, links: DataFrame, chains: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """(pair, k, j, weight, link): what ties node k of a pair's first chain to node j of its second: a node of both or a short link (weight 2), else the node right across (1).

    links are roads (id, a, b, length). A link counts up to ``RUNG`` times the separation, the shortest first, ties to the smaller id.
    A node across may lie ``ALIGN`` or the separation away along the road. Nodes with nothing of the other chain within reach have only shared nodes.
    """
    left = written(nodes.join(pairs, F.col("chain") == F.col("pair.a")).select("pair", "k", "node"))
    right = written(nodes.join(pairs, F.col("chain") == F.col("pair.b")).select(F.col("pair").alias("_pair"), F.col("k").alias("j"), F.col("node").alias("_node"), F.col("at").alias("_at")))
    shared = written(left.join(right, (F.col("pair") == F.col("_pair")) & (F.col("node") == F.col("_node"))).select("pair", "k", "j"))
    both = [shared.select(F.col("pair").alias("_s"), F.col(c).alias("_c")) for c in "kj"]
    across = written(_opposite(nodes, lines, pairs, reach).join(both[0], (F.col("pair") == F.col("_s")) & (F.col("k") == F.col("_c")), "left_anti"))
    own = chains.select(F.col("id").alias("_id"), F.col("chain").alias("_chain"))
    arms = links.where("a IS NOT NULL AND b IS NOT NULL").select("id", F.explode(F.array(F.struct(F.col("a").alias("here"), F.col("b").alias("there")), F.struct(F.col("b").alias("here"), F.col("a").alias("there")))).alias("e"), "length")
    arms = arms.join(own, F.col("id") == F.col("_id"), "left")
    at = across.join(left.select(F.col("pair").alias("_p"), F.col("k").alias("_k"), "node"), (F.col("pair") == F.col("_p")) & (F.col("k") == F.col("_k"))).drop("_p", "_k")
    tied = at.join(arms, F.col("node") == F.col("e.here")).where((F.col("length") <= RUNG * F.col("sep")) & F.coalesce((F.col("_chain") != F.col("pair.a")) & (F.col("_chain") != F.col("pair.b")), F.lit(True)))
    free = right.join(both[1], (F.col("_pair") == F.col("_s")) & (F.col("j") == F.col("_c")), "left_anti")
    tied = tied.join(free, (F.col("pair") == F.col("_pair")) & (F.col("e.there") == F.col("_node")))
    linked = written(tied.groupBy("pair", "k").agg(F.min(F.struct("length", F.col("id").alias("link"), "j")).alias("m")).select("pair", "k", "m.j", F.lit(2).alias("weight"), "m.link"))
    # opposite nodes by place along the second chain, in stretches as long as the widest slack
    stretch = F.lit(float(max(ALIGN, reach)))
    step = lambda c: F.floor(F.col(c) / stretch)
    rest = at.join(linked.select(F.col("pair").alias("_s"), F.col("k").alias("_c")), (F.col("pair") == F.col("_s")) & (F.col("k") == F.col("_c")), "left_anti")
    rest = rest.withColumn("_step", F.explode(F.sequence(step("at") - 1, step("at") + 1)))
    off = F.abs(F.col("_at") - F.col("at"))
    met = rest.join(right.withColumn("_there", step("_at")), (F.col("pair") == F.col("_pair")) & (F.col("_step") == F.col("_there"))).where(off <= F.greatest(F.lit(ALIGN), "sep"))
    met = met.groupBy("pair", "k").agg(F.min(F.struct(off.alias("off"), "j")).alias("m")).select("pair", "k", "m.j", F.lit(1).alias("weight"))
    met = met.join(both[1], (F.col("pair") == F.col("_s")) & (F.col("j") == F.col("_c")), "left_anti")
    none = F.lit(None).cast(links.schema["id"].dataType)
    return shared.select("pair", "k", "j", F.lit(2).alias("weight"), none.alias("link")).unionByName(linked).unionByName(met.withColumn("link", none))


def _heaviest(js_: list, weights: list) -> list[int]:
    """Of one tangle, sorted by k, the rows of the heaviest chain whose j falls as k rises; of equal ones that with the earliest end and predecessors."""
    js = sorted({-j for j in js_})
    tree = [(0, 0)] * (len(js) + 1)  # prefix maxima of (weight, -row)
    score, before = [], []
    for row, (j, w) in enumerate(zip(js_, weights, strict=True)):
        at = place = bisect_left(js, -j)
        best = (0, 0)
        while at:
            best, at = max(best, tree[at]), at & (at - 1)
        score.append(best[0] + w)
        before.append(-best[1] if best[0] else -1)
        at, own = place + 1, (score[-1], -row)
        while at < len(tree):
            tree[at], at = max(tree[at], own), at + (at & -at)
    keep, row = [], score.index(max(score))
    while row >= 0:
        keep.append(row)
        row = before[row]
    return keep[::-1]


def _tangles(frames):
    """The heaviest chain of each tangle of a stream of rows sorted by tangle; ``_start`` marks where one begins, and the last one of a frame waits for the next frame."""
    waiting = []
    for frame in frames:
        starts = frame["_start"].to_numpy().nonzero()[0]
        if not len(starts):
            waiting.append(frame)
            continue
        head = [*waiting, frame.iloc[: starts[0]]]
        done = pd.concat(head) if waiting else head[0]
        if len(done):
            yield done.iloc[_heaviest(done["j"].tolist(), done["weight"].tolist())]
        js, ws = (frame[c].tolist() for c in ("j", "weight"))
        keep = [low + i for low, high in zip(starts, starts[1:], strict=False) for i in _heaviest(js[low:high], ws[low:high])]
        yield frame.iloc[keep]
        waiting = [frame.iloc[starts[-1] :]]
    if waiting:
        done = pd.concat(waiting)
        yield done.iloc[_heaviest(done["j"].tolist(), done["weight"].tolist())]


def align(found: DataFrame) -> DataFrame:
    """The heaviest set of rungs (pair, k, j, weight, …; one for each k) in which j falls as k rises.

    Where every j so far is above every j to come, the sides are independent and what is best for each is best for both. So a
    pair is cut there, and only what is left in a tangle, of a few rungs on real roads, is weighed at once, many tangles a call; a single rung stays as it is.
    """
    order = Window.partitionBy("pair").orderBy("k")
    low = F.min("j").over(order.rowsBetween(Window.unboundedPreceding, -1))
    high = F.max("j").over(Window.partitionBy("pair").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    blocks = found.withColumn("_start", low.isNull() | (low > high)).withColumn("_block", F.sum(F.col("_start").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = written(blocks.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("pair", "_block"))))
    tangled = blocks.where("_n > 1").drop("_n")
    flat = tangled.withColumns({"_a": F.col("pair.a"), "_b": F.col("pair.b")}).drop("pair")
    dealt = flat.repartition("_a", "_b", "_block").sortWithinPartitions("_a", "_b", "_block", "k")
    solved = dealt.mapInPandas(_tangles, flat.schema).withColumn("pair", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")))
    columns = [c for c in blocks.columns if c not in ("_n", "_block", "_start")]
    return blocks.where("_n = 1").select(columns).unionByName(solved.select(columns))


def chain_pairs(matched: DataFrame, steps: DataFrame, chains: DataFrame, least: float = LEAST_MERGE) -> tuple[DataFrame, DataFrame]:
    """(pair, length) of chains matched over ``least`` at least, both sides counted, and (id, other, covered): how much of a road is matched with a chain.

    matched are (id, k, partner), a row a sample; steps (id, step) say how much of its road a sample stands for.
    """
    one, two = (chains.select(F.col("id").alias(f"_{c}"), F.col("chain").alias(c)) for c in ("own", "other"))
    seen = written(matched.groupBy("id", "partner").agg(F.count(F.lit(1)).alias("n")))
    known = seen.join(steps.select(F.col("id").alias("_s"), "step"), F.col("id") == F.col("_s")).join(one, F.col("id") == F.col("_own")).join(two, F.col("partner") == F.col("_other"))
    covered = written(known.groupBy("id", "own", "other").agg((F.sum("n") * F.first("step")).alias("covered")))
    pair = F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("pair")
    pairs = covered.where("own <> other").groupBy(pair).agg(F.sum("covered").alias("length")).where(F.col("length") >= least)
    return written(pairs), covered.select("id", "other", "covered")


def ladder_cells(aligned: DataFrame) -> DataFrame:
    """(cell: struct of a, b, n, k0, j0, k1, j1, links, real): what lies between a rung and the next one; ``links`` are the rungs' links."""
    order = Window.partitionBy("pair").orderBy("k")
    ahead = {f"{c}1": F.lead(c).over(order) for c in ("k", "j", "link", "weight")}
    both = aligned.withColumns({**ahead, "n": F.row_number().over(order)}).where("k1 IS NOT NULL")
    links = F.array_compact(F.array("link", "link1"))
    return both.select(F.struct("pair.a", "pair.b", "n").alias("cell"), F.col("k").alias("k0"), F.col("j").alias("j0"), "k1", "j1", links.alias("links"), (F.greatest("weight", "weight1") > 1).alias("real"))


def _strips(cells: DataFrame, lines: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roads (cell, side, id), nodes (cell, node, x, y) and outlines (id: the cell, x, y, x2, y2) of cells."""
    spans = [cells.select("cell", F.lit(side).alias("side"), F.col(f"cell.{side}").alias("_chain"), F.explode(F.sequence(low, high)).alias("_k")) for side, low, high in (("a", F.col("k0"), F.col("k1")), ("b", F.col("j1"), F.col("j0")))]
    steps = written(spans[0].unionByName(spans[1]))
    corners = written(steps.join(nodes, (F.col("_chain") == F.col("chain")) & (F.col("_k") == F.col("k"))).select("cell", "side", "k", "node", "x", "y"))
    inner = steps.join(cells.select(F.col("cell").alias("_c"), "k1", "j0"), F.col("cell") == F.col("_c")).where("_k < CASE side WHEN 'a' THEN k1 ELSE j0 END").select("cell", "side", "_chain", "_k")
    edges = written(inner.join(lines, (F.col("_chain") == F.col("chain")) & (F.col("_k") == F.col("rank"))).select("cell", "side", "id", "x", "y", "x2", "y2"))
    ends = cells.select("cell", F.explode(F.array(F.struct(F.col("k0").alias("k"), F.col("j0").alias("j")), F.struct(F.col("k1").alias("k"), F.col("j1").alias("j")))).alias("r"))
    place = [corners.where(F.col("side") == s).select(F.col("cell").alias(f"_{s}"), F.col("k").alias(f"_k{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}")) for s in "ab"]
    bars = ends.join(place[0], (F.col("cell") == F.col("_a")) & (F.col("r.k") == F.col("_ka"))).join(place[1], (F.col("cell") == F.col("_b")) & (F.col("r.j") == F.col("_kb")))
    outline = edges.select(F.col("cell").alias("id"), "x", "y", "x2", "y2").union(bars.where("xa <> xb OR ya <> yb").select("cell", "xa", "ya", "xb", "yb"))
    return edges.select("cell", "side", "id").distinct(), corners, written(outline)


def _reached(points: DataFrame, outline: DataFrame, lead: int) -> DataFrame:
    """Cells that hold one of the points or come within ``lead`` of one."""
    numbered = points.select("x", "y").distinct().withColumn("id", F.struct("x", "y"))
    near = box_join(boxed_points(numbered), boxed_segments(outline), max(64, lead), lead)
    gap2 = point_segment_distance2(*[F.col(c) for c in ("a_x", "a_y", "b_x", "b_y", "b_x2", "b_y2")])
    return near.where(gap2 <= float(lead) ** 2).select(F.col("b_id").alias("cell")).union(points_in_polygons(numbered, outline, 64).select("polygon")).distinct()


def _held(segs: DataFrame, outline: DataFrame, spacing: float, loose=lambda pairs: pairs) -> DataFrame:
    """(cell, id, n, total, held, inner): how many of the ``n`` samples of a line lie in a cell, with its edge and without; lines without any there have no row.

    Segments meet the cells' boxes first, and ``loose`` may drop pairs of a cell (b_id) and a line (a_id); samples are made where a segment passes the box.
    """
    own = with_places(segs, spacing).select("id", "x", "y", "x2", "y2", "hx", "hy", "at", "len", "n", "total", "first", "last")
    pairs = loose(box_join(boxed_segments(own), polygon_boxes(outline), 64 * ACROSS).drop("a_x0", "a_y0", "a_x1", "a_y1"))
    # along the segment a box lies between its nearest and its farthest corner
    corners = [ahead(F.col(f"b_{x}"), F.col(f"b_{y}")) for x in ("x0", "x1") for y in ("y0", "y1")]
    each = beside(pairs, corners, spacing).where(F.col("_p.x").between(F.col("b_x0"), F.col("b_x1")) & F.col("_p.y").between(F.col("b_y0"), F.col("b_y1")))
    points = each.select(F.struct(F.col("a_id").alias("id"), F.col("a_k").alias("k"), F.col("a_n").alias("n"), F.col("a_total").alias("total")).alias("id"), F.col("b_id").alias("polygon"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    hit = in_named_polygons(points, outline, 64).select(F.col("polygon").alias("cell"), "id.id", "id.n", "id.total", "on")
    return hit.groupBy("cell", "id", "n", "total").agg(F.count(F.lit(1)).alias("held"), F.sum((~F.col("on")).cast("long")).alias("inner"))


def _inside_links(found: DataFrame, cells: DataFrame, corners: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, id): links within a cell that meet nothing but the cell's own nodes and each other; others go, round by round."""
    ends = links.select("id", F.explode(F.array("a", "b")).alias("node"))
    meets = written(ends.where("node IS NOT NULL").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("arms")).select(F.col("node").alias("_m"), "arms"))
    cut = links.where("a IS NULL OR b IS NULL").select(F.col("id").alias("_cut"))
    left = written(found.join(cut, F.col("id") == F.col("_cut"), "left_anti"))
    held = corners.select(F.col("cell").alias("_c"), F.col("node").alias("_n")).distinct()
    while True:
        at = left.join(ends.select(F.col("id").alias("_e"), "node"), F.col("id") == F.col("_e")).select("cell", "id", "node").distinct()
        loose = at.join(held, (F.col("cell") == F.col("_c")) & (F.col("node") == F.col("_n")), "left_anti")
        own = loose.groupBy("cell", "node").agg(F.count(F.lit(1)).alias("n")).join(meets, F.col("node") == F.col("_m")).where("arms > n").select(F.col("cell").alias("_c"), F.col("node").alias("_n"))
        gone = written(loose.join(own, (F.col("cell") == F.col("_c")) & (F.col("node") == F.col("_n"))).select(F.col("cell").alias("_gc"), F.col("id").alias("_gi")).distinct())
        if gone.isEmpty():
            return left
        left = written(left.join(gone, (F.col("cell") == F.col("_gc")) & (F.col("id") == F.col("_gi")), "left_anti"))


def judge_cells(cells: DataFrame, lines: DataFrame, nodes: DataFrame, covered: DataFrame, links: DataFrame, link_segs: DataFrame, obstacles: DataFrame, anchors: DataFrame, lead: int, spacing: float) -> tuple[DataFrame, DataFrame]:
    """Cells with ``length`` (of the first side) and ``reason`` (null if valid), and parts (cell, role, id): the roads a cell takes.

    Reasons, the first that holds: ``overlap`` (a side matched with the other chain over less than ``OVERLAP``), ``structure`` (an anchor point
    (x, y) within the lead), ``obstacle`` (an outline (id, seq, x, y, x2, y2) with more than ``INSIDE`` of its length in the cell, by samples, or one that
    holds a node of it), ``road`` (another road that runs so between the sides). Links inside belong to the cell if ``BELONGS`` of them lies in it and
    they lead nowhere else. Roles: a, b, rung, link.
    """
    roads, corners, outline = _strips(cells, lines, nodes)
    sizes = written(lines.groupBy(F.col("id").alias("_r")).agg(F.first("chain").alias("_chain"), F.sum("len").alias("len")))
    other = F.when(F.col("side") == "a", F.col("cell.b")).otherwise(F.col("cell.a"))
    own = roads.withColumn("_other", other).join(sizes, F.col("id") == F.col("_r"))
    known = own.join(covered.select(F.col("id").alias("_i"), F.col("other").alias("_o"), "covered"), (F.col("id") == F.col("_i")) & (F.col("_other") == F.col("_o")), "left")
    sides = written(known.groupBy("cell", "side").agg(F.sum("len").alias("len"), F.sum(F.coalesce("covered", F.lit(0.0))).alias("covered")))
    bad = [sides.where(F.col("covered") < OVERLAP * F.col("len")).select("cell", F.lit(0).alias("why")), _reached(anchors, outline, lead).select("cell", F.lit(1).alias("why"))]
    held = _held(obstacles, outline, spacing)
    bad.append(held.where(F.col("inner") / F.col("n") * F.col("total") > INSIDE).select("cell", F.lit(2).alias("why")))
    ground = corners.select(F.struct("cell", "node").alias("id"), "x", "y")
    bad.append(points_in_polygons(ground, obstacles, 64, False).select(F.col("id.cell").alias("cell"), F.lit(2).alias("why")))
    # the sides' own roads and the rungs are no roads between
    rung = cells.select("cell", F.explode("links").alias("id")).distinct()
    mine = written(roads.select("cell", "id").union(rung).distinct())
    taken = mine.select(F.col("cell").alias("_mc"), F.col("id").alias("_mi"))
    loose = lambda df: df.join(taken, (F.col("b_id") == F.col("_mc")) & (F.col("a_id") == F.col("_mi")), "left_anti")
    held = written(_held(link_segs, outline, spacing, loose))
    inner = held.where(F.col("inner") / F.col("n") * F.col("total") > INSIDE).select("cell", "id")
    most = held.where(F.col("held") / F.col("n") >= BELONGS).select("cell", "id")
    members = written(_inside_links(most, cells, corners, links.select("id", "a", "b")))
    gone = members.select(F.col("cell").alias("_gc"), F.col("id").alias("_gi"))
    bad.append(inner.join(gone, (F.col("cell") == F.col("_gc")) & (F.col("id") == F.col("_gi")), "left_anti").select("cell", F.lit(3).alias("why")))
    first = bad[0].union(bad[1]).union(bad[2]).union(bad[3]).union(bad[4]).groupBy(F.col("cell").alias("_b")).agg(F.min("why").alias("why"))
    reason = F.element_at(F.array(*map(F.lit, ("overlap", "structure", "obstacle", "road"))), F.col("why") + 1)
    size = sides.where("side = 'a'").select(F.col("cell").alias("_s"), F.col("len").alias("length"))
    judged = cells.join(size, F.col("cell") == F.col("_s")).join(first, F.col("cell") == F.col("_b"), "left").withColumn("reason", F.when(F.col("why").isNotNull(), reason)).drop("_s", "_b", "why")
    parts = roads.select("cell", F.col("side").alias("role"), "id").union(rung.select("cell", F.lit("rung"), "id")).union(members.select("cell", F.lit("link"), "id"))
    return written(judged), written(parts)


def settle(judged: DataFrame, parts: DataFrame, pairs: DataFrame, rungless: DataFrame, least: float = LEAST_MERGE) -> tuple[DataFrame, int]:
    """Parts (cell, role, id, run) of the merges, and the number of rounds.

    Pairs are taken by falling length, ties by their names, and no road twice: each round settles all pairs that are the first of those left at
    every road of theirs, which is the serial order. A merge is a run of valid cells of free roads, ``run`` their first; it is ``least`` long and has a real
    rung, unless its pair is listed in rungless (pair).
    """
    both = parts.join(judged.where("reason IS NULL").select(F.col("cell").alias("_c"), "length", "real"), F.col("cell") == F.col("_c")).drop("_c")
    named = both.withColumn("pair", F.struct("cell.a", "cell.b"))
    rank = pairs.select(F.col("pair").alias("_p"), F.struct((-F.col("length")).alias("less"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).alias("rank"))
    bare = rungless.select(F.col("pair").alias("_q")).distinct()
    open_ = written(named.join(rank, F.col("pair") == F.col("_p")).drop("_p").join(bare, F.col("pair") == F.col("_q"), "left").withColumn("bare", F.col("_q").isNotNull()).drop("_q"))
    done, rounds = None, 0
    while not open_.isEmpty():
        rounds += 1
        first = open_.groupBy(F.col("id").alias("_i")).agg(F.min("rank").alias("first"))
        ready = written(open_.join(first, F.col("id") == F.col("_i")).groupBy(F.col("pair").alias("_p")).agg(F.min((F.col("rank") == F.col("first"))).alias("ok")).where("ok").select("_p"))
        now = open_.join(ready, F.col("pair") == F.col("_p"), "left_semi")
        cell = now.groupBy("pair", "cell").agg(F.first("length").alias("length"), F.first("real").alias("real"), F.first("bare").alias("bare"))
        order = Window.partitionBy("pair").orderBy("cell.n")
        islands = cell.withColumn("_i", F.col("cell.n") - F.row_number().over(order))
        whole = Window.partitionBy("pair", "_i")
        runs = islands.withColumns({"_len": F.sum("length").over(whole), "_real": F.max("real").over(whole), "run": F.min("cell.n").over(whole)}).where((F.col("_len") >= least) & (F.col("_real") | F.col("bare")))
        kept = written(now.join(runs.select(F.col("cell").alias("_c"), "run"), F.col("cell") == F.col("_c")).select("cell", "role", "id", "run"))
        done = kept if done is None else written(done.union(kept))
        used = kept.select(F.col("id").alias("_u")).distinct()
        rest = open_.join(ready, F.col("pair") == F.col("_p"), "left_anti")
        lost = rest.join(used, F.col("id") == F.col("_u"), "left_semi").select(F.col("cell").alias("_c")).distinct()
        open_ = written(rest.join(lost, F.col("cell") == F.col("_c"), "left_anti"))
    return (parts.where("false").withColumn("run", F.lit(1)) if done is None else done), rounds


def _judged(roads: DataFrame, segs: DataFrame, links: DataFrame, link_segs: DataFrame, obstacles: DataFrame, anchors: DataFrame, rungless: list[str], spacing: float, least: float, most: int, lead: int) -> tuple[DataFrame, ...]:
    """Judged cells and their parts, pairs of chains, and the pairs that may merge without a real rung."""
    whole = roads.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    chains = written(travel_chains(whole, segs))
    lines, nodes = _along(whole, segs, chains)
    kinds = whole.select(F.col("id").alias("_k"), "kind")
    own = segs.join(kinds, F.col("id") == F.col("_k")).drop("_k")
    matched = match_carriageways(own, spacing, least, most)
    total = lines.groupBy("id").agg(F.sum("len").alias("len"))
    pairs, covered = chain_pairs(matched, total.select("id", (F.col("len") / F.ceil(F.col("len") / spacing)).alias("step")), chains)
    aligned = align(written(rungs(nodes, lines, links, chains, pairs.select("pair"), most)))
    cells = written(ladder_cells(aligned))
    judged, parts = judge_cells(cells, lines, nodes, written(covered), links, link_segs, obstacles, anchors, lead, spacing)
    bare = pairs.join(kinds, F.col("pair.a") == F.col("_k")).where(F.col("kind").isin(rungless)).select("pair")
    return judged, parts, pairs, bare


def _verdicts(judged: DataFrame) -> DataFrame:
    return judged.select("cell.*", "k0", "j0", "k1", "j1", "length", "reason").withColumn("n", F.col("n").cast("long"))


def carriageway_cells(roads: DataFrame, segs: DataFrame, links: DataFrame, link_segs: DataFrame, obstacles: DataFrame, anchors: DataFrame, rungless: list[str], spacing: float = 5.0, least: float = 1.0, most: int = 35, lead: int = 8) -> DataFrame:
    """The cells that ``merge_carriageways`` gives, without its merges."""
    return _verdicts(_judged(roads, segs, links, link_segs, obstacles, anchors, rungless, spacing, least, most, lead)[0])


def merge_carriageways(roads: DataFrame, segs: DataFrame, links: DataFrame, link_segs: DataFrame, obstacles: DataFrame, anchors: DataFrame, rungless: list[str], spacing: float = 5.0, least: float = 1.0, most: int = 35, lead: int = 8) -> tuple[DataFrame, DataFrame]:
    """(a, b, n, k0, j0, k1, j1, length, reason): all cells with their verdict; and (id, role, a, b, run): the roads of each merge.

    roads (id, a, b, kind) with segs are one-way candidates, links (id, a, b, length) with link_segs all roads (candidates too). Roles: ``a`` roads carry
    the merged one, ``b``, ``rung`` and ``link`` roads are absorbed. Samples of opposite roads match at ``least`` to ``most`` between the middles. Pairs whose
    kind is in ``rungless`` may merge without a real rung. Empty tables give no rows; roads without a node or without length take no part.
    """
    judged, parts, pairs, bare = _judged(roads, segs, links, link_segs, obstacles, anchors, rungless, spacing, least, most, lead)
    merged, _ = settle(judged, parts, pairs, bare)
    roles = merged.groupBy("id", "role", "cell.a", "cell.b").agg(F.min("run").cast("long").alias("run"))
    return _verdicts(judged), roles
