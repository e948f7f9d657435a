"""Queries over streets, parts of buildings, and published rows with their reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import graph as GR
from geoloom.operators import parallels as A
from geoloom.operators import roads as R
from geoloom.operators import sequences as S
from geoloom.operators import spatial as P
from geoloom.operators import streets as T
from geoloom.operators.spatial import grown
from geoloom.plans.base import BOXES, HOMES, LINES, NEAR_SEGS, SHOPS, WAY_NODES, box_edges, boxes, homes, lines, near_lines, query, shops, table, way_nodes
from geoloom.plans.places import _roads
from geoloom.plans.space import _BOTH, _LABELS, _graph
from geoloom.sources import overlays

HOME_ROADS = f"{HOMES}, roads AS (SELECT id, x, y, x + 300 + id % 200 AS x2, 40 + id % 3 * 20 AS width FROM homes)"

@query("jon22_wet_length", f"WITH {HOME_ROADS}, {BOXES}, i AS (SELECT r.id, greatest(r.x, b.x0) AS lo, least(r.x2, b.x1) AS hi FROM roads r JOIN boxes b ON r.y > b.y0 AND r.y < b.y1 AND r.x < b.x1 AND b.x0 < r.x2), m AS (SELECT id, lo, hi, max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i), w AS (SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(seen, lo)))) AS wet FROM m GROUP BY id) SELECT r.id, CAST(coalesce(wet, 0) AS DOUBLE) AS wet FROM roads r LEFT JOIN w ON w.id = r.id")
def _(spark, d):
    return T.wet_length(_roads(homes(spark, d)), box_edges(spark, d), 500).select("id", F.round("wet", 3).alias("wet"))


@query("jon36_gate_cuts", f"WITH {HOMES}, {SHOPS}, b AS (SELECT id, x, y FROM shops), c AS (SELECT b.id, h.x - b.x - (15 + h.id % 2 * 10 + 5.0) AS start, h.x - b.x + (15 + h.id % 2 * 10 + 5.0) AS stop FROM b JOIN homes h ON h.x BETWEEN b.x AND b.x + 1000 AND b.y BETWEEN h.y - 300 AND h.y + 300), g AS (SELECT id, x + 500 + id % 3 * 100 AS x, y + id % 40 AS y FROM shops), n AS (SELECT b.id, g.x - b.x AS m, sqrt(900.0 - (g.y - b.y) * (g.y - b.y)) AS r FROM b JOIN g ON abs(g.y - b.y) < 30), u AS (SELECT id, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop FROM c UNION ALL SELECT id, greatest(m - r, 0.0), least(m + r, 1000.0) FROM n WHERE greatest(m - r, 0.0) < least(m + r, 1000.0) UNION ALL SELECT id, 1000.0, 1000.0 FROM b), f AS (SELECT *, greatest(coalesce(max(stop) OVER (PARTITION BY id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS prev FROM u) SELECT id, round(prev, 3) AS start, round(start, 3) AS stop FROM f WHERE prev < start")
def _(spark, d):
    k = F.col("id")
    own, zero = shops(spark, d), F.lit(0).cast("bigint").alias("seq")
    barriers = own.select("id", zero, "x", "y", (F.col("x") + 1000).alias("x2"), F.col("y").alias("y2"))
    ways = homes(spark, d).select("id", zero, "x", (F.col("y") - 300).alias("y"), F.col("x").alias("x2"), (F.col("y") + 300).alias("y2"), (30 + k % 2 * 20).alias("width"))
    gates = own.select("id", (F.col("x") + 500 + k % 3 * 100).alias("x"), (F.col("y") + k % 40).alias("y"), F.lit(60).alias("width"))
    return T.gate_cuts(barriers, ways, gates, 500, 5.0).select("id", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@query("jon41_snapped", f"WITH {HOMES}, {SHOPS}, roads AS (SELECT id, x, y, x + 300 + id % 200 AS x2, 40 + id % 3 * 20 AS width FROM shops), f AS (SELECT h.id, r.id AS line, h.x, h.y, r.y AS ry, r.width, greatest(r.x, least(r.x2, h.x)) AS fx FROM homes h JOIN roads r ON h.x BETWEEN r.x - 400 AND r.x2 + 400 AND abs(h.y - r.y) <= 400), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (x - fx) * (x - fx) + (y - ry) * (y - ry), line) AS k FROM f WHERE (x - fx) * (x - fx) + (y - ry) * (y - ry) <= 160000) SELECT id, line, CASE WHEN y >= ry THEN 1 ELSE -1 END AS side, CAST(fx AS DOUBLE) AS x, round(ry + CASE WHEN y >= ry THEN 1 ELSE -1 END * (width / 2 + 7.5), 3) AS y FROM n WHERE k = 1")
def _(spark, d):
    return T.snap_to_side(homes(spark, d), _roads(shops(spark, d)), 400, 7.5).select("id", "line", "side", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("jon44_opposite", f"WITH {HOME_ROADS}, p AS (SELECT a.id, CAST(sign(b.y - a.y) AS INTEGER) AS side, b.id AS other, abs(b.y - a.y) AS far FROM roads a JOIN roads b ON (a.id % 3 = 0) <> (b.id % 3 = 0) AND (a.x + a.x2) / 2 BETWEEN b.x AND b.x2 AND abs(b.y - a.y) BETWEEN a.width / 2 AND a.width / 2 + 2500) SELECT id, side, min_by(other, far * 1000000 + other) AS other FROM p GROUP BY id, side")
def _(spark, d):
    k = F.col("id")
    one_way = _roads(homes(spark, d)).withColumn("one_way", F.when(k % 3 == 0, -1).otherwise(1))
    return T.opposite(one_way, 0.0, 2500.0, 1000).select("id", "side", "other")


@query("jon45_related", f"WITH RECURSIVE {_BOTH}, {_LABELS}, {HOMES}, t AS (SELECT *, id % 3 AS grp, id * 2 AS node FROM homes), n AS (SELECT a.id, b.grp, b.id AS other, a.node AS an, b.node AS bn, row_number() OVER (PARTITION BY a.id, b.grp ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS k FROM t a JOIN t b ON b.grp = a.grp + 1 AND a.id <> b.id) SELECT id, grp, other, coalesce(p.label = q.label, false) AS connected FROM n LEFT JOIN r p ON p.node = an LEFT JOIN r q ON q.node = bn WHERE k = 1")
def _(spark, d):
    k = F.col("id")
    sites = homes(spark, d).select("id", (k % 3).alias("grp"), "x", "y", (k * 2).alias("node"))
    groups = sites.select("grp").distinct()  # a few kinds
    return T.related(sites, groups.select("grp", (F.col("grp") + 1).alias("adjacent")), GR.components(_graph(spark, d)), 250)


_UNSHARED = "x AS (SELECT a.id AS a_id, b.id AS b_id FROM segs a JOIN segs b ON a.id < b.id AND greatest(a.x, a.x2) >= least(b.x, b.x2) AND greatest(b.x, b.x2) >= least(a.x, a.x2) WHERE sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0 AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0 AND NOT EXISTS (SELECT 1 FROM way_nodes p JOIN way_nodes q ON p.ref = q.ref WHERE p.id = a.id AND q.id = b.id))"


@query("gra10_level_ways", f"WITH {NEAR_SEGS}, {_UNSHARED} SELECT DISTINCT id FROM way_nodes WHERE id NOT IN (SELECT a_id FROM x UNION SELECT b_id FROM x)")
def _(spark, d):
    found = R.unshared(P.crossings(S.segments(near_lines(spark, d)), 250), way_nodes(spark, d))
    return T.level_ways(way_nodes(spark, d).select("id").distinct(), found)


_USES = f"{WAY_NODES}, u AS (SELECT ref FROM (SELECT DISTINCT id, ref FROM way_nodes) GROUP BY ref HAVING count(*) > 1), e AS (SELECT id, min_by(ref, seq) AS a, max_by(ref, seq) AS b, count(*) AS n FROM way_nodes GROUP BY id), l AS (SELECT ref FROM way_nodes WHERE id IN (SELECT id FROM e WHERE a = b AND n > 1)), h AS (SELECT id FROM way_nodes WHERE ref IN (SELECT ref FROM l))"


def _sparse(spark, d):
    """Ways whose nodes are shared by few."""
    k = F.col("id")
    return way_nodes(spark, d).select("id", "seq", (F.col("ref") * 40 + k % 40).alias("ref"))


@query("gra19_sections", f"WITH {_USES.replace('l_partkey AS ref', 'l_partkey * 40 + l_orderkey % 40 AS ref')} SELECT w.id, count(*) AS vertices, CASE WHEN w.id IN (SELECT id FROM h) THEN 1 ELSE count(*) FILTER (seq > 1 AND seq < n AND w.ref IN (SELECT ref FROM u)) + 1 END AS pieces FROM way_nodes w JOIN e ON e.id = w.id GROUP BY w.id")
def _(spark, d):
    cut = T.sections(_sparse(spark, d))
    again = F.count(F.lit(1)) - F.count_distinct("piece") + 1  # a cut vertex belongs to both pieces
    return cut.groupBy("id").agg(again.alias("vertices"), F.count_distinct("piece").alias("pieces"))


@query("gra19_admitted", "SELECT l_orderkey AS id, count(*) AS pieces, count(*) FILTER (l_partkey % 4 > 0) AS fine FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_partkey % 4 > 0) > 0 AND (l_orderkey % 3 > 0 OR count(*) = count(*) FILTER (l_partkey % 4 > 0))")
def _(spark, d):
    k = F.col("id")
    return T.admitted(way_nodes(spark, d).select("id", F.col("seq").alias("piece"), (F.col("ref") % 4 > 0).alias("ok"), (k % 3 == 0).alias("structure")))


@query("jon10_part_faults", f"WITH {BOXES} SELECT id, CASE id % 6 WHEN 1 THEN 'area' WHEN 2 THEN 'overlap' WHEN 3 THEN 'outside' WHEN 4 THEN 'missing' END AS fault FROM boxes WHERE id % 6 BETWEEN 1 AND 4")
def _(spark, d):
    k = F.col("id")
    b, kind = boxes(spark, d), k % 6
    middle = F.floor((F.col("x0") + F.col("x1")) / 2)
    left = b.select((k * 2).alias("id"), k.alias("parent"), "x0", "y0", middle.alias("x1"), "y1")
    right = b.select((k * 2 + 1).alias("id"), k.alias("parent"), (middle - F.when(kind == 2, 100).otherwise(0)).alias("x0"), (F.col("y0") + F.when(kind == 1, 50).when(kind == 2, 60).otherwise(0)).alias("y0"), (F.col("x1") + F.when(kind == 3, 70).otherwise(0)).alias("x1"), "y1")
    corner = F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]))
    parts = left.union(right).where("parent % 6 <> 4")
    edges = S.segments(parts.select("id", corner.alias("seq", "p")).select("id", "seq", "p.x", "p.y"), closed=True)
    return T.check_parts(box_edges(spark, d), edges.withColumn("parent", F.floor(k / 2)), 500)


def _square(x, y, size, closed):
    pts = [F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (size, 0), (size, size), (0, size))]
    last = F.struct((x + F.when(closed, 0.0).otherwise(0.1)).alias("x"), y.alias("y"))
    return F.array(F.array(F.array(*pts, last)))


def _listed(*rules: tuple[str, str]) -> str:
    """SQL: the names whose condition holds, in order, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in rules) + ") AS reasons"


def _sourced(k):
    name = F.when(k % 13 == 0, F.lit("")).otherwise("survey")
    return F.array(F.struct(name.alias("dataset"), F.lit(None).cast("string").alias("license")))


_BUILDING = [("underground", "k % 19 = 0"), ("vertical", "k % 5 = 0 OR k % 6 = 0"), ("nested", "k % 10 = 0"), ("parent", "(k % 5 = 0) <> (k % 35 = 1 OR (k % 5 = 0 AND k % 7 > 0))"), ("ring", "k % 17 = 0"), ("outside", "k % 12 >= 10"), ("sources", "k % 13 = 0"), ("height", "k % 4 > 0 AND k % 31 = 0")]


@query("src09_building_rows", f"SELECT k AS part, {_listed(*_BUILDING)} FROM (SELECT p_partkey AS k FROM part)")
def _(spark, d):
    k = F.col("p_partkey").cast("bigint")
    building_id = F.when((k % 35 == 1) | ((k % 5 == 0) & (k % 7 > 0)), F.lit("parent"))
    rows = table(spark, d, "part").select(
        k.alias("part"), F.concat(F.lit("b"), k.cast("string")).alias("id"), F.when(k % 5 == 0, "building_part").otherwise("building").alias("type"), F.lit(1).alias("version"),
        F.when(k % 4 > 0, F.when(k % 31 == 0, 0.0).otherwise(k % 90 + 1.0)).alias("height"), F.when(k % 6 == 0, 2.0).otherwise(0.0).alias("min_height"), (k % 10 == 0).alias("has_parts"), (k % 19 == 0).alias("is_underground"),
        building_id.alias("building_id"), _sourced(k).alias("sources"), _square((k % 12).cast("double"), (k % 9).cast("double"), 0.5, k % 17 != 0).alias("geometry"),
    )
    return overlays.building_rows(rows, (0.0, 0.0, 10.0, 10.0)).select("part", F.array_join("reasons", ",").alias("reasons"))


_COVER = [("subtype", "k % 11 = 10"), ("zoom", "k % 4 = 3"), ("resolution", "k % 4 = 2"), ("sources", "k % 13 = 0"), ("ring", "k % 17 = 0"), ("outside", "k % 12 >= 10")]


@query("src10_land_cover_rows", f"SELECT k AS part, reasons, CASE WHEN reasons <> '' THEN NULL WHEN k % 11 <> 2 THEN 'other-subtype' WHEN k % 4 = 0 THEN 'forest' ELSE 'lower-detail' END AS disposition FROM (SELECT k, {_listed(*_COVER)} FROM (SELECT p_partkey AS k FROM part))")
def _(spark, d):
    k = F.col("p_partkey").cast("bigint")
    kinds = F.array(*map(F.lit, [*overlays.LAND_COVERS, "lava"]))
    zooms = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ((8, 15), (0, 7), (8, 13), (5, 3))])
    zoom = F.get(zooms, (k % 4).cast("int"))
    rows = table(spark, d, "part").select(k.alias("part"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.get(kinds, (k % 11).cast("int")).alias("subtype"), zoom["low"].alias("min_zoom"), zoom["high"].alias("max_zoom"), _sourced(k).alias("sources"), _square((k % 12).cast("double"), (k % 9).cast("double"), 0.5, k % 17 != 0).alias("geometry"))
    return overlays.land_cover_rows(rows, (0.0, 0.0, 10.0, 10.0)).select("part", F.array_join("reasons", ",").alias("reasons"), "disposition")


_ROAD = [("version", "k % 29 = 0"), ("sources", "k % 13 = 0"), ("outside", "k % 11 = 10"), ("line", "k % 3 > 0 AND k % 7 = 0"), ("class", "k % 3 > 0 AND k % 5 = 4"), ("level", "k % 3 > 0 AND k % 17 = 0"), ("flags", "k % 3 > 0 AND k % 8 = 0")]


@query("src11_transport_rows", f"SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'connector' ELSE 'segment' END AS kind, {_listed(*_ROAD)} FROM (SELECT o_orderkey AS k FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey").cast("bigint")
    x, y = k % 11 + 0.5, k % 9 + 0.5
    point = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    points = F.when(k % 3 == 0, F.array(point(0.0, 0.0))).when(k % 7 == 0, F.array(point(0.0, 0.0), point(0.0, 0.0))).otherwise(F.array(point(0.0, 0.0), point(0.2, 0.1)))
    classes = F.array(*map(F.lit, ("residential", "primary", "service", "track", "spaceway")))
    flags = F.when(k % 8 == 0, F.array(F.lit("is_bridge"))).when(k % 8 == 1, F.array(F.lit("is_link")))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "connector").otherwise("segment").alias("type"), (k % 29).alias("version"), F.lit("road").alias("subtype"), F.get(classes, (k % 5).cast("int")).alias("class"),
        F.when(k % 17 == 0, 1).alias("level"), flags.alias("flags"), _sourced(k).alias("sources"), points.alias("points"),
    )
    segments, connectors = overlays.transport_rows(rows, (0.0, 0.0, 10.0, 10.0), ["residential", "primary", "service", "track"])
    both = segments.withColumn("kind", F.lit("segment")).unionByName(connectors.withColumn("kind", F.lit("connector")))
    return both.select("o_orderkey", "kind", F.array_join("reasons", ",").alias("reasons"))


def _parallel(spark, d):
    """Roads of which every third runs backwards, in two kinds."""
    k = F.col("id")
    r, back = _roads(homes(spark, d)), k % 3 == 0
    turned = {"x": F.when(back, F.col("x2")).otherwise(F.col("x")), "x2": F.when(back, F.col("x")).otherwise(F.col("x2"))}
    return r.withColumns(turned).withColumn("kind", k % 2)


_SAMPLES = "s AS (SELECT id, width, y, CASE WHEN id % 3 = 0 THEN x2 - k * 50 ELSE x + k * 50 END AS x, k, CAST(ceil((x2 - x) / 50.0) AS BIGINT) AS n FROM (SELECT *, unnest(range(CAST(ceil((x2 - x) / 50.0) AS BIGINT))) AS k FROM roads))"


@query("jon23_carriageways", f"WITH {HOME_ROADS}, {_SAMPLES}, p AS (SELECT s.id, s.k, b.id AS partner, sqrt(pow(greatest(b.x - s.x, 0, s.x - b.x2), 2) + pow(b.y - s.y, 2)) AS gap FROM s JOIN roads b ON b.id <> s.id AND b.id % 2 = s.id % 2 AND (b.id % 3 = 0) <> (s.id % 3 = 0) AND abs(b.y - s.y) <= 700 AND b.x - 700 <= s.x AND s.x <= b.x2 + 700), r AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY gap, partner) AS i FROM p WHERE gap BETWEEN 50 AND 700) SELECT id, k, partner, round(gap, 3) AS gap FROM r WHERE i = 1")
def _(spark, d):
    return A.match_carriageways(_parallel(spark, d), 50.0, 50.0, 700).select("id", "k", "partner", F.round("gap", 3).alias("gap"))


_WALKS = f"WITH {HOME_ROADS}, {_SAMPLES}, f AS (SELECT id, x + 10 AS x, x + 260 AS x2, y + CASE WHEN id % 4 = 0 THEN -1 ELSE 1 END * (25 + id % 30) AS y, 16 + id % 4 AS w FROM homes), d AS (SELECT s.id, k, n, CASE WHEN (f.y - s.y) * CASE WHEN s.id % 3 = 0 THEN -1 ELSE 1 END >= 0 THEN 1 ELSE -1 END AS side, f.id AS footway, sqrt(pow(greatest(f.x - s.x, 0, s.x - f.x2), 2) + pow(f.y - s.y, 2)) AS gap, f.w, s.width FROM s JOIN f ON abs(f.y - s.y) <= 120 AND f.x - 120 <= s.x AND s.x <= f.x2 + 120), e AS (SELECT *, gap + w / 2 - width / 2 AS o FROM d WHERE gap - width / 2 <= 80), m AS (SELECT id, side, n, k, min(o) AS o FROM e GROUP BY ALL), g AS (SELECT id, side, list_sort(list(o))[len(list(o)) // 2 + 1] AS \"offset\" FROM m GROUP BY id, side, n HAVING count(*) * 2 >= n)"


def _sidewalks(spark, d):
    k = F.col("id")
    y = F.col("y") + F.when(k % 4 == 0, -1).otherwise(1) * (25 + k % 30)
    footways = homes(spark, d).select("id", F.lit(0).cast("bigint").alias("seq"), (F.col("x") + 10).alias("x"), y.alias("y"), (F.col("x") + 260).alias("x2"), y.alias("y2"), (16 + k % 4).alias("width"))
    return footways, A.match_sidewalks(_parallel(spark, d), footways, 50.0, 80, 80)


@query("jon24_sidewalks", f'{_WALKS} SELECT id, side, round("offset", 3) AS "offset" FROM g')
def _(spark, d):
    return _sidewalks(spark, d)[1][0].select("id", "side", F.round("offset", 3).alias("offset"))


@query("jon25_absorbed_footways", f'{_WALKS}, pairs AS (SELECT DISTINCT e.id AS road, footway FROM e JOIN g ON g.id = e.id AND g.side = e.side), b AS (SELECT r.*, r.width / 2 + (SELECT max("offset") FROM g WHERE g.id = r.id) + 0.25 AS band FROM roads r), q AS (SELECT f.id, k, p.road FROM f JOIN (SELECT unnest(range(5)) AS k) ON true JOIN pairs p ON p.footway = f.id JOIN b ON b.id = p.road WHERE sqrt(pow(greatest(b.x - (f.x + k * 50), 0, f.x + k * 50 - b.x2), 2) + pow(f.y - b.y, 2)) <= band), c AS (SELECT id, road, count(*) AS n FROM q GROUP BY id, road) SELECT id, min_by(road, -n * 1000000 + road) AS owner FROM c WHERE id IN (SELECT id FROM q GROUP BY id HAVING count(DISTINCT k) = 5) GROUP BY id')
def _(spark, d):
    footways, (sides, pairs) = _sidewalks(spark, d)
    wide = sides.groupBy(F.col("id").alias("_id")).agg(F.max("offset").alias("_o"))
    roads = grown(_parallel(spark, d)).join(wide, F.col("id") == F.col("_id")).withColumn("band", F.col("width") / 2.0 + F.col("_o") + 0.25)
    return A.absorbed_footways(footways, roads, pairs, 50.0, 200)


_FLAT = "CASE WHEN {d} = 0 THEN CASE WHEN {a} BETWEEN {low} AND {high} THEN {inside} ELSE NULL END ELSE {f}(({low} - {a}) / {d}, ({high} - {a}) / {d}) END"
_SLABS = {f"{c}{n}": _FLAT.format(d=f"d{c}", a=c, low=low, high=high, inside=n, f=("least", "greatest")[n]) for c, low, high in (("x", 20000, 80000), ("y", 30000, 70000)) for n in (0, 1)}
_CROP = f"""WITH {LINES}, g AS (SELECT id, seq, x, y, ref % 50 AS z, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(ref % 50) OVER w AS z2 FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq)),
h AS (SELECT *, CAST(bx - x AS DOUBLE) AS dx, CAST(by_ - y AS DOUBLE) AS dy FROM g WHERE bx IS NOT NULL),
s AS (SELECT *, {_SLABS['x0']} AS ax, {_SLABS['x1']} AS zx, {_SLABS['y0']} AS ay, {_SLABS['y1']} AS zy FROM h),
t AS (SELECT *, CASE WHEN ax IS NULL OR ay IS NULL THEN NULL ELSE greatest(0.0, ax, ay) END AS t0, CASE WHEN ax IS NULL OR ay IS NULL THEN NULL ELSE least(1.0, zx, zy) END AS t1 FROM s),
u AS (SELECT *, NOT coalesce(lag(CASE WHEN t0 <= t1 THEN t1 END) OVER (PARTITION BY id ORDER BY seq) = 1 AND t0 = 0, false) AS fresh FROM t),
v AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY id ORDER BY seq) - 1 AS piece FROM u WHERE t0 < t1),
k AS (SELECT *, sum(sqrt(dx * dx + dy * dy) * (t1 - t0)) OVER (PARTITION BY id, piece) AS size FROM v),
e AS (SELECT id, piece, seq AS q, 0 AS i, t0 AS t, t0 > 0 AS cut, x, y, z, dx, dy, z2 FROM k WHERE fresh AND size >= 5000 UNION ALL SELECT id, piece, seq, 1, t1, t1 < 1, x, y, z, dx, dy, z2 FROM k WHERE size >= 5000)
SELECT id, CAST(piece AS BIGINT) AS piece, row_number() OVER (PARTITION BY id, piece ORDER BY q, i) AS seq, round(x + t * dx, 3) AS x, round(y + t * dy, 3) AS y, round(z + t * (z2 - z), 3) AS z, cut FROM e"""


@query("pip01_cropped_lines", _CROP)
def _(spark, d):
    points = lines(spark, d).select("id", "seq", "x", "y", (F.col("ref") % 50).alias("z"))
    kept, _ = S.crop_lines(points, (20000, 30000, 80000, 70000), 5000.0)
    return kept.select("id", "piece", "seq", *[F.round(c, 3).alias(c) for c in ("x", "y", "z")], "cut")
