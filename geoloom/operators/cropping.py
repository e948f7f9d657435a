"""Polygons cut at a window: chains of edges inside it, joined along its sides, ordered by list ranking.

No polygon is gathered. An edge knows by itself where it enters and leaves the window; a chain's number comes from
a scan by chunks of the ring; the cuts of a polygon are put in order by stretches of the window's sides; and
the chains of a new ring are ranked by pointer jumping. The sides count as outside, as if moved in by less than any
distance, so that touching in a point or along a side leaves nothing, and ties are told apart by slope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import written

#: Edges of a ring that are scanned together, and stretches that each side of a window is divided into.
CHUNK, STRETCHES = 4096, 64
SIDES = ("west", "south", "east", "north")


def oriented(edges: DataFrame) -> DataFrame:
    """Edges (id, ring, role, seq, n, x, y, x2, y2) with the area to their left: outer rings counter-clockwise, inner ones clockwise."""
    area = edges.groupBy(F.col("id").alias("_id"), F.col("ring").alias("_ring")).agg(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).alias("_area"))
    both = edges.join(area, (F.col("id") == F.col("_id")) & (F.col("ring") == F.col("_ring")))
    turn = (F.col("_area") > 0) != (F.col("role") == "outer")
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in edges.columns if c not in ("seq", "x", "y", "x2", "y2")]
    return both.select(*rest, F.when(turn, F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq")).alias("seq"), swap("x", "x2"), swap("y", "y2"), swap("x2", "x"), swap("y2", "y"))


def _inside(x: str, y: str) -> Column:
    return (F.col(x) > F.col("west")) & (F.col(x) < F.col("east")) & (F.col(y) > F.col("south")) & (F.col(y) < F.col("north"))


def _crossed(entering: bool) -> Column:
    """The cut of an edge on its way in or out: struct<side, along, slope, x, y>, side 0 to 3 counter-clockwise from the south."""
    options = []
    for a, b, low, high in (("x", "y", "west", "east"), ("y", "x", "south", "north")):
        d, other = F.col(f"{a}2") - F.col(a), F.col(f"{b}2") - F.col(b)
        ahead = (d > 0) if entering else (d < 0)
        edge = F.when(ahead, F.col(low)).otherwise(F.col(high))
        t = (edge - F.col(a)) / d.cast("double")
        there = F.col(b) + (edge - F.col(a)) * other / d.cast("double")
        side = F.when(ahead, 3).otherwise(1) if a == "x" else F.when(ahead, 0).otherwise(2)
        # along a side runs counter-clockwise: south to the east, east to the north and so on
        sign = F.when(ahead, -1).otherwise(1) if a == "x" else F.when(ahead, 1).otherwise(-1)
        inward = other if entering else -other
        point = (edge.cast("double"), there) if a == "x" else (there, edge.cast("double"))
        cut = F.struct(side.alias("side"), (sign * there).alias("along"), (sign * inward / F.abs(d).cast("double")).alias("slope"), point[0].alias("x"), point[1].alias("y"))
        # of two sides met at once, in a corner, the slower axis decides, as it comes last on the way in and first on the way out
        key = (F.when(d != 0, t), 1.0 / F.abs(d)) if entering else (F.when(d != 0, -t), 1.0 / F.abs(d))
        options.append(F.when(d != 0, F.struct(key[0].alias("t"), key[1].alias("slow"), cut.alias("cut"))))
    return F.greatest(*options)["cut"]


def _corner(k: Column) -> Column:
    """The corner at the end of side k."""
    k = F.pmod(k, F.lit(4))
    x = F.when(k.isin(0, 1), F.col("east")).otherwise(F.col("west"))
    y = F.when(k.isin(1, 2), F.col("north")).otherwise(F.col("south"))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _chains(edges: DataFrame) -> DataFrame:
    """Edges with ``chain``, the seq of the edge by which their chain came in, for rings with cuts: the last way in at or before them."""
    way_in = F.when(F.col("cut_in").isNotNull(), F.col("seq"))
    named = edges.withColumns({"_chunk": F.floor(F.col("seq") / CHUNK), "_in": way_in})
    chunks = named.groupBy("id", "ring", "_chunk").agg(F.max("_in").alias("_last"))
    before = Window.partitionBy("id", "ring").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumns({"_carried": F.last("_last", ignorenulls=True).over(before), "_ever": F.max("_last").over(Window.partitionBy("id", "ring"))})
    carried = carried.select(F.col("id").alias("_id"), F.col("ring").alias("_ring"), F.col("_chunk").alias("_c"), F.coalesce("_carried", "_ever").alias("_before"))
    own = F.last("_in", ignorenulls=True).over(Window.partitionBy("id", "ring", "_chunk").orderBy("seq"))
    both = named.withColumn("_own", own).join(carried, (F.col("id") == F.col("_id")) & (F.col("ring") == F.col("_ring")) & (F.col("_chunk") == F.col("_c")))
    return both.withColumn("chain", F.coalesce("_own", "_before")).drop("_chunk", "_in", "_id", "_ring", "_c", "_own", "_before")


def _following(cuts: DataFrame) -> DataFrame:
    """Cuts (id, way, cut, ...) with ``next``, the cut that follows along the window's sides, and ``wrapped``, whether it lies before."""
    low = F.element_at(F.array("west", "south", "east", "north"), F.when(F.col("cut.side") == 0, 1).when(F.col("cut.side") == 1, 2).when(F.col("cut.side") == 2, 3).otherwise(4))
    low = F.when(F.col("cut.side") >= 2, -low).otherwise(low)
    length = F.when(F.col("cut.side") % 2 == 0, F.col("east") - F.col("west")).otherwise(F.col("north") - F.col("south"))
    stretch = F.least(F.lit(STRETCHES - 1), F.greatest(F.lit(0), F.floor((F.col("cut.along") - low) / length * STRETCHES))) + F.col("cut.side") * STRETCHES
    place = F.struct(F.col("cut.side").alias("side"), F.col("cut.along").alias("along"), F.col("cut.slope").alias("slope"), "way", "ring", "chain", F.col("cut.x").alias("x"), F.col("cut.y").alias("y"))
    placed = cuts.withColumns({"_stretch": stretch, "_place": place})
    firsts = placed.groupBy("id", "_stretch").agg(F.min("_place").alias("_first"))
    all_, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("_stretch")
    firsts = firsts.withColumns({"_after": F.lead("_first").over(order), "_least": F.min("_first").over(all_)}).select(F.col("id").alias("_id"), F.col("_stretch").alias("_s"), "_after", "_least")
    near = placed.withColumn("_near", F.lead("_place").over(Window.partitionBy("id", "_stretch").orderBy("_place")))
    both = near.join(firsts, (F.col("id") == F.col("_id")) & (F.col("_stretch") == F.col("_s")))
    return both.withColumns({"next": F.coalesce("_near", "_after", "_least"), "wrapped": F.coalesce("_near", "_after").isNull()})


def _ranked(links: DataFrame) -> DataFrame:
    """(id, chain, ring, offset) of links (id, chain, next, size) in cycles: a cycle is named by its smallest chain, which has offset 0."""
    links = written(links)
    jumps = links.select("id", "chain", "next", F.col("chain").alias("low"))
    while True:
        there = jumps.select(F.col("id").alias("_i"), F.col("chain").alias("_c"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        met = jumps.join(there, (F.col("id") == F.col("_i")) & (F.col("next") == F.col("_c")))
        jumps = written(met.select("id", "chain", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")))
        if jumps.where("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    named = links.join(jumps.select(F.col("id").alias("_i"), F.col("chain").alias("_c"), "low"), (F.col("id") == F.col("_i")) & (F.col("chain") == F.col("_c")))
    ranks = written(named.select("id", "chain", "low", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"), F.col("size").cast("long").alias("left")))
    while not ranks.where("next IS NOT NULL").isEmpty():
        there = ranks.select(F.col("id").alias("_i"), F.col("chain").alias("_c"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        met = ranks.join(there, (F.col("id") == F.col("_i")) & (F.col("next") == F.col("_c")), "left")
        ranks = written(met.select("id", "chain", "low", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    whole = ranks.where("chain = low").select(F.col("id").alias("_i"), F.col("low").alias("_l"), F.col("left").alias("_all"))
    return ranks.join(whole, (F.col("id") == F.col("_i")) & (F.col("low") == F.col("_l"))).select("id", "chain", F.col("low").alias("ring"), (F.col("_all") - F.col("left")).alias("offset"))


def crop_polygons(edges: DataFrame, window: tuple[Column | int, Column | int, Column | int, Column | int]) -> tuple[DataFrame, DataFrame]:
    """Polygons cut at a window (west, south, east, north): (id, ring, seq, x, y, cut), and (id, verdict).

    edges are (id, ring, role, seq from 0, n, x, y, x2, y2) of sound polygons in whole numbers, role outer or inner. The window is one
    for all, or columns that are equal in all edges of a polygon. A polygon inside stays as it is (``whole``); others are ``cut``
    into rings named struct<ring, chain>, areas to the left, a ``cut`` vertex being one on the window's side; the window itself is a ring
    of a polygon around it. Those without a common area are ``contact`` where they touch the window, else ``outside``, and give no rings. Parts
    of a polygon that meet in a point only are rings of their own. A ring is read from its smallest chain on.
    Polygons whose rings cross or overlap at the window's side, so that ways in and out don't alternate, are ``unsound`` and give no rings.
    A null coordinate or an empty window (west >= east or south >= north) makes a polygon ``unsound`` too.
    """
    given = oriented(edges.select("id", "ring", "role", "seq", "n", "x", "y", "x2", "y2", *[(F.lit(w) if isinstance(w, int) else w).alias(c) for w, c in zip(window, SIDES, strict=True)]))
    # a ray to the west of the window's corner, just inside it; asked only of polygons without cuts
    spans = (F.col("y") > F.col("south")) != (F.col("y2") > F.col("south"))
    reaches = F.col("x") + (F.col("south") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y")).cast("double")
    left = F.when(spans, reaches <= F.col("west")).otherwise(False)
    cut_in = F.when(~_inside("x", "y"), _crossed(True))
    cut_out = F.when(~_inside("x2", "y2"), _crossed(False))
    t0, t1 = (f(*[F.when(F.col(f"{a}2") != F.col(a), f2((F.col(lo) - F.col(a)) / (F.col(f"{a}2") - F.col(a)).cast("double"), (F.col(hi) - F.col(a)) / (F.col(f"{a}2") - F.col(a)).cast("double"))) for a, lo, hi in (("x", "west", "east"), ("y", "south", "north"))], F.lit(edge)) for f, f2, edge in ((F.greatest, F.least, 0.0), (F.least, F.greatest, 1.0)))
    flat = lambda a, lo, hi: (F.col(a) != F.col(f"{a}2")) | ((F.col(a) > F.col(lo)) & (F.col(a) < F.col(hi)))
    runs_in = (t0 < t1) & flat("x", "west", "east") & flat("y", "south", "north")
    marked = written(given.withColumn("runs_in", runs_in).withColumns({"cut_in": F.when(F.col("runs_in"), cut_in), "cut_out": F.when(F.col("runs_in"), cut_out), "left": left}))
    least, most = (lambda c: F.min(F.least(c, f"{c}2"))), (lambda c: F.max(F.greatest(c, f"{c}2")))
    per = marked.groupBy("id").agg(
        *[F.first(c).alias(c) for c in SIDES], least("x").alias("x0"), least("y").alias("y0"), most("x").alias("x1"), most("y").alias("y1"),
        F.max(F.col("runs_in").cast("int")).alias("some"), F.count("cut_in").alias("ins"), F.count("cut_out").alias("outs"), (F.sum(F.col("left").cast("int")) % 2 == 1).alias("around"),
        F.max((F.col("x").isNull() | F.col("y").isNull() | F.col("x2").isNull() | F.col("y2").isNull()).cast("int")).alias("missing"),
    )
    whole = (F.col("x0") >= F.col("west")) & (F.col("x1") <= F.col("east")) & (F.col("y0") >= F.col("south")) & (F.col("y1") <= F.col("north"))
    apart = (F.col("x0") > F.col("east")) | (F.col("x1") < F.col("west")) | (F.col("y0") > F.col("north")) | (F.col("y1") < F.col("south"))
    covered = (F.col("ins") == 0) & F.col("around") & ~apart
    unsound = (F.col("missing") == 1) | (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north")) | (F.col("ins") != F.col("outs"))
    verdict = F.when(unsound, "unsound").when(whole, "whole").when((F.col("some") == 1) | covered, "cut").when(apart, "outside").otherwise("near")
    per = written(per.select("id", *SIDES, verdict.alias("verdict"), (covered & ~whole & ~unsound).alias("covered")))
    told = per.select(F.col("id").alias("_p"), "verdict")
    live = marked.join(told.where("verdict IN ('whole', 'cut')"), F.col("id") == F.col("_p")).drop("_p")
    cut = live.where("verdict = 'cut' AND runs_in")
    ringed = _chains(cut)
    ringed = written(ringed.select("id", "ring", "seq", "n", "x", "y", "x2", "y2", *SIDES, "cut_in", "cut_out", "chain"))
    name = F.struct("ring", "chain")
    cuts = ringed.where("cut_in IS NOT NULL").select("id", "ring", "chain", "seq", *SIDES, F.lit(0).alias("way"), F.col("cut_in").alias("cut"))
    cuts = cuts.unionByName(ringed.where("cut_out IS NOT NULL").select("id", "ring", "chain", "seq", *SIDES, F.lit(1).alias("way"), F.col("cut_out").alias("cut")))
    follow = written(_following(cuts).select("id", "ring", "chain", "way", "cut", "next", "wrapped", *SIDES))
    bad = written(follow.where("way = next.way").select(F.col("id").alias("_bad")).distinct())
    good = lambda df: df.join(bad, F.col("id") == F.col("_bad"), "left_anti")
    exits = good(follow.where("way = 1"))
    turns = F.when(F.col("wrapped") & (F.col("next.side") == F.col("cut.side")), 4).otherwise(F.pmod(F.col("next.side") - F.col("cut.side"), F.lit(4)))
    corners = F.transform(F.slice(F.array(*map(F.lit, range(4))), 1, turns), lambda k: _corner(F.col("cut.side") + k))
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])
    last = F.struct(F.col("cut.x").alias("x"), F.col("cut.y").alias("y"))
    tail = F.filter(F.concat(F.array(last), F.filter(corners, lambda p: ~same(p, F.col("cut")))), lambda p: ~same(p, F.col("next")))
    tails = written(exits.select("id", "ring", "chain", F.struct(F.col("next.ring").alias("ring"), F.col("next.chain").alias("chain")).alias("then"), tail.alias("tail")))
    inner = good(ringed.where("chain IS NOT NULL"))
    place = F.pmod(F.col("seq") - F.col("chain"), F.col("n")).cast("long")
    heads = inner.select("id", name.alias("chain"), place.alias("at"), F.coalesce("cut_in.x", F.col("x").cast("double")).alias("x"), F.coalesce("cut_in.y", F.col("y").cast("double")).alias("y"), F.col("cut_in").isNotNull().alias("cut"))
    sizes = heads.groupBy("id", "chain").agg(F.count(F.lit(1)).alias("size"))
    ends = tails.select(F.col("id").alias("_i"), name.alias("_c"), F.col("then").alias("next"), "tail")
    sized = written(sizes.join(ends, (F.col("id") == F.col("_i")) & (F.col("chain") == F.col("_c"))).select("id", "chain", "next", "size", "tail"))
    order = _ranked(sized.select("id", "chain", "next", (F.col("size") + F.size("tail")).alias("size")))
    order = order.select(F.col("id").alias("_i"), F.col("chain").alias("_c"), F.col("ring").alias("_r"), "offset")
    behind = sized.select("id", "chain", F.posexplode("tail").alias("k", "p"), "size").select("id", "chain", (F.col("size") + F.col("k")).cast("long").alias("at"), "p.x", "p.y", F.lit(True).alias("cut"))
    joined = heads.unionByName(behind).join(order, (F.col("id") == F.col("_i")) & (F.col("chain") == F.col("_c")))
    joined = joined.select("id", F.col("_r").alias("ring"), (F.col("offset") + F.col("at")).alias("seq"), "x", "y", "cut")
    plain = F.struct("ring", F.lit(None).cast("long").alias("chain")).alias("ring")
    kept = live.where("verdict = 'whole'").select("id", plain, F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(False).alias("cut"))
    free = good(ringed.where("chain IS NULL")).select("id", plain, F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(False).alias("cut"))
    nameless = F.struct(F.lit(None).cast(given.schema["ring"].dataType).alias("ring"), F.lit(None).cast("long").alias("chain")).alias("ring")
    frame = per.where("covered AND verdict = 'cut'").select("id", nameless, F.posexplode(F.array(*[_corner(F.lit(k)) for k in (3, 0, 1, 2)])).alias("seq", "p")).select("id", "ring", F.col("seq").cast("long").alias("seq"), "p.x", "p.y", F.lit(True).alias("cut"))
    touch = good(marked).where(_touches()).select(F.col("id").alias("_t")).distinct()
    final = F.when(F.col("_bad").isNotNull(), "unsound").when(F.col("verdict") != "near", F.col("verdict")).when(F.col("_t").isNotNull(), "contact").otherwise("outside")
    verdicts = per.join(bad, F.col("id") == F.col("_bad"), "left").join(touch, F.col("id") == F.col("_t"), "left").select("id", final.alias("verdict"))
    rows = kept.unionByName(free).unionByName(joined.withColumn("ring", F.struct(F.col("ring.ring").alias("ring"), F.col("ring.chain").cast("long").alias("chain")))).unionByName(frame)
    return rows, verdicts


def _touches() -> Column:
    """Whether an edge has a point in common with the closed window."""
    parts = []
    for a, lo, hi in (("x", "west", "east"), ("y", "south", "north")):
        d = (F.col(f"{a}2") - F.col(a)).cast("double")
        s, t = (F.col(lo) - F.col(a)) / d, (F.col(hi) - F.col(a)) / d
        parts.append((F.when(d != 0, F.least(s, t)).otherwise(0.0), F.when(d != 0, F.greatest(s, t)).otherwise(1.0), (d != 0) | F.col(a).between(F.col(lo), F.col(hi))))
    low, high = F.greatest(F.lit(0.0), parts[0][0], parts[1][0]), F.least(F.lit(1.0), parts[0][1], parts[1][1])
    return parts[0][2] & parts[1][2] & (low <= high)
