"""Heights of bridges and tunnels that say only their layer: chains of them, ramps over ground ways, what fails until nothing fails.

Ways are (id, a, b, layer, structure, bridge, candidate, level, walking), their vertices (id, seq, ref, x, y) in metres with seq from 1.
``candidate`` ways are structures off layer 0 without heights of their own; ``level`` ones lie on the ground by decision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import segment_gap2, segments_cross
from geoloom.operators.carriageways import ranked
from geoloom.operators.graph import components, written
from geoloom.operators.sequences import arc_length, segments
from geoloom.operators.spatial import segment_pairs

#: Metres a layer, steepest ramp, level lead at both ends, room before a crossing, least separation; half the width that bends are made for. Fixed values.
DECK = 6.0
GRADE = 0.08
LEAD = 8.0
ROOM = 10.0
SEPARATION = 5.0
MOUTH = 12.0


def profile(at: Column, total: Column, layer: Column) -> Column:
    """Height at a place of a chain: level leads, ramps, and a deck as high as the layer asks for."""
    rise = F.greatest(F.lit(0.0), F.least(at - LEAD, total - at - LEAD) * GRADE)
    return F.when(rise > 0, F.signum(layer) * F.least(DECK * F.abs(layer), rise)).otherwise(0.0)


def _arms(ways: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, arms): road arms at each node, and (id): ways without another road between their ends."""
    last = vertices.groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_last"))
    at = vertices.join(last, F.col("id") == F.col("_id")).select("id", F.col("ref").alias("node"), ((F.col("seq") > 1) & (F.col("seq") < F.col("_last"))).alias("inner"))
    arms = written(at.groupBy("node").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("arms")))
    busy = at.where("inner").join(arms.where("arms <> 2").withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left_semi").select(F.col("id").alias("_b")).distinct()
    return arms, ways.where("a <> b").join(busy, F.col("id") == F.col("_b"), "left_anti").select("id")


def _joins(ways: DataFrame, arms: DataFrame) -> DataFrame:
    """(node, lo, hi): two ways that meet end to end where nothing else does; each a struct of way and side (0: starts here)."""
    ends = ways.select(F.col("id").alias("way"), F.posexplode(F.array("a", "b")).alias("side", "node"))
    own = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("way", "side")).alias("lo"), F.max(F.struct("way", "side")).alias("hi"))
    two = own.where("n = 2 AND lo.way <> hi.way").join(arms.where("arms = 2").withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left_semi")
    return written(two.select("node", "lo", "hi"))


def _both(joins: DataFrame) -> DataFrame:
    """(from, to): who leaves a way through one end enters the other way through its end; structs of way and side."""
    return joins.select(F.explode(F.array(F.struct(F.col("lo").alias("from"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("from"), F.col("lo").alias("to")))).alias("s")).select("s.*")


def structure_chains(ways: DataFrame, joins: DataFrame) -> DataFrame:
    """(chain, rank, way, backward): candidates of one layer that follow each other end to end, ``chain`` the smallest of them, which is walked forward.

    Each way is two darts, one a direction, so an undirected chain is two lists; closed chains are left out.
    """
    layer = ways.where("candidate").select(F.col("id").alias("_w"), "layer")
    steps = _both(joins).join(layer.withColumnRenamed("layer", "_l"), F.col("from.way") == F.col("_w")).drop("_w").join(layer, (F.col("to.way") == F.col("_w")) & (F.col("layer") == F.col("_l")))
    prev = steps.select(F.struct(F.col("to.way").alias("way"), F.col("to.side").alias("side")).alias("_dart"), F.struct(F.col("from.way").alias("way"), (1 - F.col("from.side")).alias("side")).alias("prev"))
    darts = ways.where("candidate").select(F.explode(F.array(*[F.struct(F.col("id").alias("way"), F.lit(side).alias("side")) for side in (0, 1)])).alias("id"))
    order = written(ranked(darts.join(prev, F.col("id") == F.col("_dart"), "left").select("id", "prev")))
    low = order.groupBy(F.col("first").alias("_f")).agg(F.min("id").alias("low")).where("low.side = 0")
    return order.join(low, F.col("first") == F.col("_f")).select(F.col("low.way").alias("chain"), "rank", F.col("id.way").alias("way"), (F.col("id.side") == 1).alias("backward"))


def crossings_along(segs: DataFrame, cell: int) -> DataFrame:
    """(id, other, at, there): where ways cross, as lengths along both; null where they touch or overlap away from a shared vertex. Both directions.

    segs are (id, seq, x, y, x2, y2, at, len).
    """
    # written, so that the long exact conditions are not part of the join's, and run for pairs whose boxes meet
    needed = [f"{s}_{k}" for s in "ab" for k in ("id", "seq", "x", "y", "x2", "y2", "at", "len")]
    pairs = written(segment_pairs(segs, segs, cell).where("a_id < b_id").select(*needed))
    c = {f"{s}_{k}": F.col(f"{s}_{k}").cast("double") for s in "ab" for k in ("x", "y", "x2", "y2")}
    ax, ay, ax2, ay2, bx, by, bx2, by2 = c.values()
    cross = segments_cross(*c.values())
    end = lambda x, y: ((x == bx) & (y == by)) | ((x == bx2) & (y == by2))
    touch = ~cross & (segment_gap2(*c.values()) == 0) & ~end(ax, ay) & ~end(ax2, ay2)
    over = (ax2 - ax) * (by2 - by) - (ay2 - ay) * (bx2 - bx)
    t = ((bx - ax) * (by2 - by) - (by - ay) * (bx2 - bx)) / over
    u = ((bx - ax) * (ay2 - ay) - (by - ay) * (ax2 - ax)) / over
    met = pairs.where(cross | touch).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_seq", "b_seq", F.when(cross, F.col("a_at") + t * F.col("a_len")).alias("p"), F.when(cross, F.col("b_at") + u * F.col("b_len")).alias("q")).distinct()
    met = written(met)
    return met.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("p").alias("at"), F.col("q").alias("there")).union(met.select("b", "a", "q", "p"))


def _ramps(needs: DataFrame, ways: DataFrame, joins: DataFrame, plain: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chain, end, step, way, backward): ground ways that continue chains until they are as long as needed.

    needs are (chain, end: 0 or 1, way, side: of the way's end that is the chain's, need). All walk at once, a way a round. A way that two walks want goes to
    the smaller chain, then end 0; the other stops before it. What lies beyond is the first one's already, so this is what
    one chain after another would take.
    """
    able = plain.join(ways.where("NOT candidate AND (NOT structure OR level)").select(F.col("id").alias("_ok")), F.col("id") == F.col("_ok"), "left_semi").join(sizes, F.col("id") == F.col("_s")).select(F.col("id").alias("_to"), "size")
    links = written(_both(joins).join(able, F.col("to.way") == F.col("_to")).select(F.col("from").alias("_from"), "to", "size"))
    front = written(needs.where("need > 0").select("chain", "end", F.struct("way", "side").alias("at"), "need", F.lit(0).cast("long").alias("step"), F.array("way").alias("path")))
    rounds = []
    while True:
        near = front.where("need > 0").join(links, F.col("at") == F.col("_from")).where(~F.array_contains("path", F.col("to.way")))
        rest = near.select("chain", "end", F.struct(F.col("to.way").alias("way"), (1 - F.col("to.side")).alias("side")).alias("at"), (F.col("need") - F.col("size")).alias("need"), (F.col("step") + 1).alias("step"), F.concat("path", F.array("to.way")).alias("path"))
        front = written(rest)
        if front.isEmpty():
            break
        rounds.append(front.select("chain", "end", "step", F.col("at.way").alias("way"), F.when(F.col("end") == 1, F.col("at.side") == 0).otherwise(F.col("at.side") == 1).alias("backward")))
    if not rounds:
        return front.select("chain", "end", "step", F.col("at.way").alias("way"), F.lit(False).alias("backward"))
    claims = written(reduce(DataFrame.union, rounds))
    owner = claims.groupBy(F.col("way").alias("_w")).agg(F.min(F.struct("chain", "end")).alias("own"))
    lost = claims.join(owner, F.col("way") == F.col("_w")).where("own <> struct(chain, end)").groupBy(F.col("chain").alias("_c"), F.col("end").alias("_e")).agg(F.min("step").alias("stop"))
    return claims.join(lost, (F.col("chain") == F.col("_c")) & (F.col("end") == F.col("_e")), "left").where("stop IS NULL OR step < stop").select("chain", "end", "step", "way", "backward")


def _failing(alive: DataFrame, met: DataFrame, place: DataFrame, flat: DataFrame) -> DataFrame:
    """(chain, why): living chains that can't stay: ``separation`` from a road they cross, or ``nothing`` (no bridge and nothing drawn that it crosses). Ways of ``flat`` (_flat) are drawn on the ground."""
    own = place.join(alive.select(F.col("chain").alias("_c"), "total", "layer"), F.col("chain") == F.col("_c")).select(F.col("way").alias("_way"), F.col("chain").alias("_own"), "offset", "size", "backward", "total", "layer")
    spot = lambda at: F.col("offset") + F.when(F.col("backward"), F.col("size") - F.col(at)).otherwise(F.col(at))
    here = met.join(own, F.col("id") == F.col("_way")).withColumn("h", profile(spot("at"), F.col("total"), F.col("layer"))).drop("_way", "offset", "size", "backward", "total", "layer").withColumnRenamed("_own", "chain")
    both = here.join(own, F.col("other") == F.col("_way"), "left").withColumn("h2", F.when(F.col("_own").isNull(), 0.0).otherwise(profile(spot("there"), F.col("total"), F.col("layer"))))
    both = both.join(flat, F.col("other") == F.col("_flat"), "left")
    seen = both.where((F.col("_own").isNull() & (F.col("drawn") | F.col("_flat").isNotNull())) | (F.col("_own") != F.col("chain")))
    close = F.col("at").isNull() | (F.abs(F.col("h") - F.col("h2")) < SEPARATION)
    judged = seen.groupBy(F.col("chain").alias("_j")).agg(F.max(close).alias("close"))
    found = alive.join(judged, F.col("chain") == F.col("_j"), "left")
    why = F.when(F.col("close"), "separation").when(F.col("close").isNull() & ~F.col("bridge"), "nothing")
    return found.withColumn("why", why).where("why IS NOT NULL").select("chain", "key", "component", "why")


def estimate_structures(ways: DataFrame, vertices: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """(chain, status) and (chain, way, backward, offset, total, layer): the ways of chains that keep estimated heights, ramps included.

    A chain rises 6 m a layer. It needs a ramp before its first and after its last crossing, over itself and then over whole ground ways up to a junction.
    Status: ``estimated``; ``level`` (no bridge, and crosses nothing drawn or only open walking ways); ``branched`` (a road meets it on the way); ``shape`` (a
    node met twice, a vertex of a closed road, or too sharp a bend); ``separation`` (less than 5 m from a road it crosses). Of the chains that fail,
    the one whose first way is smallest goes first and the rest is judged again: each round drops one in every group of chains that cross each other, so the groups don't wait
    for each other and the outcome is the serial one. A structure without heights isn't drawn and holds nobody up. Closed chains have no row.
    """
    ways, segs = written(ways), written(arc_length(segments(vertices)).select("id", "seq", "x", "y", "x2", "y2", "at", "len", "total"))
    arms, plain = _arms(ways, vertices)
    plain, joins = written(plain), _joins(ways, arms)
    core = written(structure_chains(ways, joins))
    tags = ways.select(F.col("id").alias("_t"), "layer", "bridge", "walking", "structure", "candidate", "level")
    met = crossings_along(segs, cell).join(tags.select("_t", (~F.col("structure") | F.col("level") | F.col("candidate")).alias("shown"), (~F.col("structure") | F.col("level")).alias("drawn")), F.col("other") == F.col("_t")).drop("_t")
    met = written(met)
    sizes = written(segs.groupBy(F.col("id").alias("_s")).agg(F.sum("len").alias("size")))
    sound = core.join(plain.select(F.col("id").alias("_p")), F.col("way") == F.col("_p"), "left").join(tags.select("_t", "layer", "bridge"), F.col("way") == F.col("_t"))
    crossed = met.where("shown").select(F.col("id").alias("_x")).distinct()
    sound = sound.join(crossed, F.col("way") == F.col("_x"), "left")
    kinds = sound.groupBy("chain").agg(F.first("layer").alias("layer"), F.max("bridge").alias("bridge"), F.max(F.col("_p").isNull()).alias("branched"), F.max(F.col("_x").isNotNull()).alias("crossed"))
    first = F.when(F.col("branched"), "branched").when(~F.col("bridge") & ~F.col("crossed"), "level")
    kinds = written(kinds.withColumn("status", first))
    # where crossings lie along a chain, and what its ends still need
    span = lambda df, *by: df.withColumn("offset", F.coalesce(F.sum("size").over(Window.partitionBy("chain").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    open_ = kinds.where("status IS NULL").select(F.col("chain").alias("_k"), "layer")
    mine = written(span(core.join(open_, F.col("chain") == F.col("_k")).join(sizes, F.col("way") == F.col("_s")).drop("_k", "_s"), "rank"))
    spot = F.col("offset") + F.when(F.col("backward"), F.col("size") - F.col("at")).otherwise(F.col("at"))
    cuts = mine.join(met.where("at IS NOT NULL").select(F.col("id").alias("_m"), "at"), F.col("way") == F.col("_m"), "left")
    ramp = LEAD + DECK * F.abs("layer") / GRADE + ROOM
    ends = cuts.groupBy("chain").agg(F.first("layer").alias("layer"), F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.max(F.col("offset") + F.col("size")).alias("total"), F.min_by(F.struct("way", F.col("backward").cast("int").alias("side")), "rank").alias("head"), F.max_by(F.struct("way", (1 - F.col("backward").cast("int")).alias("side")), "rank").alias("tail"))
    need = F.array(F.struct(F.lit(0).alias("end"), F.col("head").alias("e"), (ramp - F.coalesce("lo", ramp)).alias("need")), F.struct(F.lit(1).alias("end"), F.col("tail").alias("e"), (ramp - F.col("total") + F.coalesce("hi", F.lit(0.0))).alias("need")))
    needs = written(ends.select("chain", F.explode(need).alias("n")).select("chain", "n.end", "n.e.way", "n.e.side", "n.need"))
    more = _ramps(needs, ways, joins, plain, sizes)
    place = F.when(F.col("end") == 0, -F.col("step")).otherwise(F.lit(1 << 40) + F.col("step"))
    whole = mine.select("chain", F.col("rank").alias("rank"), "way", "backward").unionByName(more.select("chain", place.alias("rank"), "way", "backward"))
    paths = written(span(whole.join(sizes, F.col("way") == F.col("_s")).drop("_s"), "rank"))
    # shapes that native structures can't have
    loops = ways.where("a = b").select(F.col("id").alias("_l"))
    closed = vertices.join(loops, F.col("id") == F.col("_l"), "left_semi").select(F.col("ref").alias("_r")).distinct()
    own = paths.join(vertices.select(F.col("id").alias("_v"), "seq", "ref"), F.col("way") == F.col("_v"))
    looped = own.join(closed, F.col("ref") == F.col("_r"), "left_semi").select("chain")
    counts = own.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref").alias("refs"), F.count_distinct("rank").alias("ways"))
    twice = counts.where("refs <> n - ways + 1").select("chain")
    ahead = paths.select(F.col("chain").alias("_g"), "way", "backward", "offset", "size", "rank").join(segs.withColumnRenamed("at", "_at"), F.col("way") == F.col("id"))
    flow = ahead.select(F.col("_g").alias("chain"), "rank", F.when(F.col("backward"), -F.col("seq")).otherwise(F.col("seq")).alias("_q"), "len", *[(F.when(F.col("backward"), F.col(c) - F.col(f"{c}2")).otherwise(F.col(f"{c}2") - F.col(c)) / F.col("len")).alias(f"d{c}") for c in "xy"])
    order = Window.partitionBy("chain").orderBy("rank", "_q")
    bends = flow.withColumns({"_len": F.lead("len").over(order), "_dx": F.lead("dx").over(order), "_dy": F.lead("dy").over(order)}).where("_len IS NOT NULL")
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dx") * F.col("_dx") + F.col("dy") * F.col("_dy"))))
    sharp = (F.col("len") == 0) | (F.col("_len") == 0) | (turn > F.lit(3.141592653589793 / 3)) | ((F.least("len", "_len") < MOUTH * F.tan(turn / 2) + 2) & (turn > F.radians(F.lit(2.0))))
    crooked = bends.where(F.coalesce(sharp, F.lit(True))).select("chain")
    odd = looped.union(twice).union(crooked).select(F.col("chain").alias("_o")).distinct()
    kinds = written(kinds.join(odd, F.col("chain") == F.col("_o"), "left").withColumn("status", F.coalesce("status", F.when(F.col("_o").isNotNull(), "shape"))).drop("_o"))
    # judged until nothing fails, in groups of chains that cross each other
    length = paths.groupBy(F.col("chain").alias("_n")).agg(F.sum("size").alias("total"), F.min_by("way", "rank").alias("key"))
    alive = kinds.where("status IS NULL").join(length, F.col("chain") == F.col("_n")).select("chain", "layer", "bridge", "total", "key")
    held = paths.select(F.col("way").alias("_w"), F.col("chain").alias("_c"))
    pairs = met.join(held, F.col("id") == F.col("_w")).select(F.col("_c").alias("a"), "other").join(held, F.col("other") == F.col("_w")).select("a", F.col("_c").alias("b")).where("a <> b")
    group = components(pairs)
    alive = written(alive.join(group.select(F.col("node").alias("_g"), "component"), F.col("chain") == F.col("_g"), "left").withColumn("component", F.coalesce("component", "chain")).drop("_g"))
    dropped, named = [], core.select(F.col("chain").alias("_of"), F.col("way").alias("_flat"))
    flat = written(named.join(kinds.where("status = 'level'").select(F.col("chain").alias("_d")), F.col("_of") == F.col("_d"), "left_semi").select("_flat"))
    while True:
        fails = written(_failing(alive, met, paths, flat))
        if fails.isEmpty():
            break
        gone = written(fails.groupBy("component").agg(F.min(F.struct("key", "chain", "why")).alias("m")).select(F.col("m.chain").alias("_d"), F.when(F.col("m.why") == "nothing", "level").otherwise("separation").alias("why")))
        dropped.append(gone)
        flat = written(flat.union(named.join(gone.where("why = 'level'"), F.col("_of") == F.col("_d"), "left_semi").select("_flat")))
        alive = written(alive.join(gone, F.col("chain") == F.col("_d"), "left_anti"))
    lost = reduce(DataFrame.union, dropped) if dropped else kinds.where("false").select(F.col("chain").alias("_d"), F.lit("").alias("why"))
    status = written(kinds.join(lost, F.col("chain") == F.col("_d"), "left").select("chain", "bridge", F.coalesce("status", "why", F.lit("estimated")).alias("status")))
    # a chain that crosses nothing drawn but open walking ways, which are paint, lies on the ground too
    kept = paths.join(alive.select(F.col("chain").alias("_c"), "total", "layer"), F.col("chain") == F.col("_c")).drop("_c", "rank", "size")
    kept = written(kept)
    risen = kept.select(F.col("way").alias("_up")).distinct()
    on_loop = vertices.join(closed, F.col("ref") == F.col("_r"), "left_semi").select(F.col("id").alias("_q")).distinct()
    paint = ways.where("walking AND NOT structure").join(risen, F.col("id") == F.col("_up"), "left_anti").join(on_loop, F.col("id") == F.col("_q"), "left_anti").select(F.col("id").alias("_paint"))
    own = core.select(F.col("way").alias("_w"), F.col("chain").alias("_c"))
    hits = met.where("shown").join(own, F.col("id") == F.col("_w")).drop("_w").withColumnRenamed("_c", "chain").join(own, F.col("other") == F.col("_w"), "left").where("_c IS NULL OR _c <> chain").join(paint, F.col("other") == F.col("_paint"), "left")
    soft = hits.groupBy(F.col("chain").alias("_h")).agg(F.min(F.col("_paint").isNotNull()).alias("soft")).where("soft")
    final = status.join(soft, F.col("chain") == F.col("_h"), "left").withColumn("status", F.when(F.col("_h").isNotNull() & ~F.col("bridge") & ~F.col("status").isin("estimated", "level"), "level").otherwise(F.col("status")))
    return final.select("chain", "status"), kept


def structure_points(kept: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, at, x, y, height, ref): vertices of estimated ways by length along them, with those added (ref null) where the profile bends."""
    points = written(arc_length(segments(vertices)).select("id", "seq", "x", "y", "x2", "y2", "at", "len"))
    own = kept.select("way", "backward", "offset", "total", "layer").join(points.groupBy(F.col("id").alias("_s")).agg(F.sum("len").alias("size")), F.col("way") == F.col("_s")).drop("_s")
    spot = F.col("offset") + F.when(F.col("backward"), F.col("size") - F.col("at")).otherwise(F.col("at"))
    place = points.groupBy("id").agg(F.max(F.struct("seq", "x2", "y2", (F.col("at") + F.col("len")).alias("at"))).alias("e"))
    corners = points.select("id", "seq", "at", "x", "y").unionByName(place.select("id", (F.col("e.seq") + 1).alias("seq"), F.col("e.at").alias("at"), F.col("e.x2").alias("x"), F.col("e.y2").alias("y")))
    named = corners.join(vertices.select(F.col("id").alias("_v"), F.col("seq").alias("_q"), "ref"), (F.col("id") == F.col("_v")) & (F.col("seq") == F.col("_q"))).drop("_v", "_q", "seq")
    given = named.join(own, F.col("id") == F.col("way")).select("id", "at", "x", "y", F.round(profile(spot, F.col("total"), F.col("layer")), 6).alias("height"), "ref")
    top = F.lit(LEAD) + F.abs(profile(F.col("total") / 2, F.col("total"), F.col("layer"))) / GRADE
    tops = F.when(F.col("total") - 2 * top >= 1.0, F.array(top, F.col("total") - top)).otherwise(F.array(F.col("total") / 2))
    bends = own.withColumn("d", F.explode(F.array_distinct(F.concat(F.array(F.lit(LEAD), F.col("total") - LEAD), tops)))).where("d > 0 AND d < total")
    inside = bends.withColumn("_at", F.when(F.col("backward"), F.col("offset") + F.col("size") - F.col("d")).otherwise(F.col("d") - F.col("offset")))
    met = inside.join(points, F.col("way") == F.col("id")).where((F.col("_at") > F.col("at") + 0.5) & (F.col("_at") < F.col("at") + F.col("len") - 0.5))
    t = (F.col("_at") - F.col("at")) / F.col("len")
    added = met.select("id", F.col("_at").alias("at"), *[(F.col(c) + t * (F.col(f"{c}2") - F.col(c))).alias(c) for c in "xy"], F.round(profile(F.col("d"), F.col("total"), F.col("layer")), 6).alias("height"), F.lit(None).cast(vertices.schema["ref"].dataType).alias("ref"))
    return given.unionByName(added)
