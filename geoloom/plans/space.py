"""Queries over spatial joins, references, groups, change sets, rankings, graphs and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import aggregates as A
from geoloom.operators import changes as C
from geoloom.operators import graph as GR
from geoloom.operators import references as R
from geoloom.operators import sequences as S
from geoloom.operators import spatial as P
from geoloom.operators import terrain as TE
from geoloom.plans.base import BOXES, HOMES, NEAR_SEGS, NODES, SHOPS, WAY_NODES, box_edges, boxes, homes, lines, near_lines, nodes, query, shops, table, way_nodes

INSIDE = f"{HOMES}, {BOXES}, inside AS (SELECT h.id, b.id AS polygon FROM homes h JOIN boxes b ON h.x BETWEEN b.x0 AND b.x1 AND h.y BETWEEN b.y0 AND b.y1)"


@query("jon14_points_in_polygons", f"WITH {INSIDE} SELECT id, polygon FROM inside")
def inside(spark, d):
    return P.points_in_polygons(homes(spark, d), box_edges(spark, d), 500)


@query("jon14_strictly_inside", f"WITH {HOMES}, {BOXES} SELECT h.id, b.id AS polygon FROM homes h JOIN boxes b ON h.x > b.x0 AND h.x < b.x1 AND h.y > b.y0 AND h.y < b.y1")
def _(spark, d):
    return P.points_in_polygons(homes(spark, d), box_edges(spark, d), 500, boundary=False)


@query("jon15_first_region", f"WITH {INSIDE} SELECT h.id, h.x, h.y, coalesce((SELECT 'region ' || min_by(polygon % 5, (polygon * 7) % 25) FROM inside i WHERE i.id = h.id), 'default') AS region FROM homes h")
def _(spark, d):
    regions = boxes(spark, d).select(F.col("id").alias("polygon"), ((F.col("id") * 7) % 25).alias("ord"), F.concat(F.lit("region "), (F.col("id") % 5).cast("string")).alias("region"))
    return P.first_region(homes(spark, d), inside(spark, d), regions, "default")


@query("jon16_smallest_site", f"WITH {INSIDE}, m AS (SELECT i.id, min_by(polygon, (b.x1 - b.x0) * (b.y1 - b.y0) * 100000 + polygon) AS site FROM inside i JOIN boxes b ON b.id = i.polygon GROUP BY i.id) SELECT h.id, CASE WHEN site IS NULL THEN 'tile' ELSE 'site' END AS kind, coalesce(CAST(site AS VARCHAR), (x // 256) || ':' || (y // 256)) AS key FROM homes h LEFT JOIN m ON m.id = h.id")
def _(spark, d):
    areas = boxes(spark, d).select(F.col("id").alias("polygon"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return P.smallest_site(homes(spark, d), inside(spark, d), areas, 256)


@query("jon18_within_distance", f"WITH {HOMES}, {SHOPS} SELECT h.id AS a_id, s.id AS b_id, (h.x - s.x) * (h.x - s.x) + (h.y - s.y) * (h.y - s.y) AS d2 FROM homes h JOIN shops s ON (h.x - s.x) * (h.x - s.x) + (h.y - s.y) * (h.y - s.y) <= 90000")
def _(spark, d):
    return P.within_distance(homes(spark, d), shops(spark, d), 300).select("a_id", "b_id", "d2")


@query("jon19_nearest_line", f"WITH {SHOPS}, {HOMES}, seg AS (SELECT id, x, y, lead(x) OVER (ORDER BY id) AS x2, lead(y) OVER (ORDER BY id) AS y2 FROM shops), t AS (SELECT h.id, s.id AS line, h.x, h.y, s.x AS ax, s.y AS ay, CAST(s.x2 - s.x AS DOUBLE) AS dx, CAST(s.y2 - s.y AS DOUBLE) AS dy FROM homes h JOIN seg s ON s.x2 IS NOT NULL AND h.x BETWEEN least(s.x, s.x2) - 400 AND greatest(s.x, s.x2) + 400 AND h.y BETWEEN least(s.y, s.y2) - 400 AND greatest(s.y, s.y2) + 400), u AS (SELECT *, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS p FROM t), v AS (SELECT id, line, (x - (ax + p * dx)) ** 2 + (y - (ay + p * dy)) ** 2 AS d2 FROM u) SELECT id, min({{'d2': d2, 'line': line}}).line AS line FROM v WHERE d2 <= 160000 GROUP BY id")
def _(spark, d):
    own = shops(spark, d).select("id", "x", "y")
    # a chain over the shops, whose keys have no gaps
    seg = own.join(own.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    return P.nearest_line(homes(spark, d), seg, 400).select("id", "line")


@query("jon20_crossings", f"WITH {NEAR_SEGS}, s AS (SELECT * FROM segs) SELECT a.id AS a_id, a.seq AS a_seq, b.id AS b_id, b.seq AS b_seq FROM s a JOIN s b ON a.id < b.id AND greatest(a.x, a.x2) >= least(b.x, b.x2) AND greatest(b.x, b.x2) >= least(a.x, a.x2) WHERE sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0 AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0")
def _(spark, d):
    return P.crossings(S.segments(near_lines(spark, d)), 250)


@query("jon38_box_overlap", f"WITH {BOXES} SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def _(spark, d):
    return P.box_join(boxes(spark, d), boxes(spark, d), 700).select("a_id", "b_id")


@query("jon39_occupancy", f"WITH {BOXES} SELECT id, cx, cy FROM (SELECT id, unnest(range((x0 - 50) // 1000, (x1 + 50) // 1000 + 1)) AS cx, y0, y1 FROM boxes WHERE x0 >= 50 OR x0 < 50) c, LATERAL (SELECT unnest(range(CAST(floor((c.y0 - 50) / 1000.0) AS BIGINT), CAST(floor((c.y1 + 50) / 1000.0) AS BIGINT) + 1)) AS cy)".replace("(x0 - 50) // 1000, (x1 + 50) // 1000 + 1", "CAST(floor((x0 - 50) / 1000.0) AS BIGINT), CAST(floor((x1 + 50) / 1000.0) AS BIGINT) + 1"))
def _(spark, d):
    return P.occupancy(boxes(spark, d), 1000, 50).select("id", "cx", "cy")


@query("jon42_not_near", f"WITH {HOMES}, {SHOPS} SELECT h.id FROM homes h WHERE NOT EXISTS (SELECT 1 FROM shops s WHERE (h.x - s.x) * (h.x - s.x) + (h.y - s.y) * (h.y - s.y) <= 1000000)")
def _(spark, d):
    return P.not_near(homes(spark, d), shops(spark, d), 1000).select("id")


@query("agg14_cell_costs", f"WITH {NODES} SELECT x // 10000 AS cx, y // 10000 AS cy, count(*) AS n, CASE WHEN count(*) > 24 THEN 'over' WHEN count(*) * 4 >= 72 THEN 'high' ELSE 'normal' END AS band FROM nodes GROUP BY ALL")
def _(spark, d):
    cells = nodes(spark, d).select(F.floor(F.col("x") / 10000).alias("cx"), F.floor(F.col("y") / 10000).alias("cy"))
    return A.density(cells, 24)


@query("jon29_bilinear", "WITH g AS (SELECT vec_id AS row, unnest(range(0, 64)) AS col, unnest(embedding) AS h FROM embeddings), p AS (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 37 % 620) / 10.0 AS x, (c_custkey * 53 % (SELECT max(vec_id) * 10 FROM embeddings)) / 10.0 AS y FROM customer), k AS (SELECT id, floor(x) AS c, floor(y) AS r, x - floor(x) AS fu, y - floor(y) AS fv FROM p) SELECT id, CAST(round(10000 * (a.h * (1 - fu) * (1 - fv) + b.h * fu * (1 - fv) + e.h * (1 - fu) * fv + f.h * fu * fv)) AS BIGINT) AS h FROM k JOIN g a ON a.row = r AND a.col = c JOIN g b ON b.row = r AND b.col = c + 1 JOIN g e ON e.row = r + 1 AND e.col = c JOIN g f ON f.row = r + 1 AND f.col = c + 1")
def _(spark, d):
    k = F.col("c_custkey").cast("bigint")
    pts = table(spark, d, "customer").select(k.alias("id"), (k * 37 % 620 / 10.0).alias("x"), (k * 53 % _span(spark, d) / 10.0).alias("y"))
    return P.bilinear(pts, _raster(spark, d), 0.0, 0.0, 1.0).select("id", F.round(F.col("h") * 10000).cast("bigint").alias("h"))


def _span(spark, d):
    """Tenths of a row over which points are spread."""
    return table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] * 10


def _raster(spark, d):
    """All vectors as the rows of a raster."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "h")).withColumn("h", F.col("h").cast("double"))


RASTER = "g AS (SELECT vec_id AS row, CAST(unnest(range(0, 64)) AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS h FROM embeddings)"


@query("win12_opening", f"WITH {RASTER}, a AS (SELECT row, col, min(h) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM g), b AS (SELECT row, col, min(h) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM a), c AS (SELECT row, col, max(h) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM b) SELECT row, col, max(h) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM c")
def _(spark, d):
    return TE.opening(_raster(spark, d), 2)


@query("win13_gaussian", f"WITH {RASTER}, a AS (SELECT row, col, 0.25 * coalesce(lag(h) OVER w, h) + 0.5 * h + 0.25 * coalesce(lead(h) OVER w, h) AS h FROM g WINDOW w AS (PARTITION BY row ORDER BY col)) SELECT row, col, CAST(round(100000 * (0.25 * coalesce(lag(h) OVER w, h) + 0.5 * h + 0.25 * coalesce(lead(h) OVER w, h))) AS BIGINT) AS h FROM a WINDOW w AS (PARTITION BY col ORDER BY row)")
def _(spark, d):
    return TE.gaussian(_raster(spark, d), [0.25, 0.5, 0.25]).select("row", "col", F.round(F.col("h") * 100000).cast("bigint").alias("h"))


@query("jon01_resolved", f"WITH {WAY_NODES}, {NODES}, k AS (SELECT * FROM nodes WHERE id % 101 <> 0) SELECT id, seq, ref, x, y FROM (SELECT w.*, k.x, k.y, bool_or(k.id IS NULL) OVER (PARTITION BY w.id) AS bad FROM way_nodes w LEFT JOIN k ON w.ref = k.id) WHERE NOT bad")
def _(spark, d):
    return R.resolve(way_nodes(spark, d), nodes(spark, d).where("id % 101 <> 0"))[0].select("id", "seq", "ref", "x", "y")


@query("jon01_missing", f"WITH {WAY_NODES} SELECT id, count(*) AS missing FROM way_nodes WHERE ref % 101 = 0 GROUP BY id")
def _(spark, d):
    return R.resolve(way_nodes(spark, d), nodes(spark, d).where("id % 101 <> 0"))[1]


@query("jon02_node_tags", f"WITH {WAY_NODES} SELECT w.id, w.seq, w.ref, p.p_type AS kind FROM way_nodes w LEFT JOIN (SELECT * FROM part WHERE p_size > 40) p ON p.p_partkey = w.ref")
def _(spark, d):
    tags = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    return R.with_tags(way_nodes(spark, d), tags)


def _members(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    way = o.select(F.col("o_custkey").alias("relation"), F.lit("way").alias("type"), k.alias("ref"), F.lit("outer").alias("role"))
    node = o.select(F.col("o_custkey").alias("relation"), F.lit("node").alias("type"), (k % 3000).alias("ref"), F.lit("entrance").alias("role"))
    return way.unionByName(node)


MEMBERS = "m AS (SELECT o_custkey AS relation, 'way' AS type, o_orderkey AS ref, 'outer' AS role FROM orders UNION ALL SELECT o_custkey, 'node', o_orderkey % 3000, 'entrance' FROM orders)"


@query("jon03_members", f"WITH {MEMBERS} SELECT m.*, CASE WHEN type = 'way' THEN ref IN (SELECT l_orderkey FROM lineitem) ELSE ref IN (SELECT p_partkey FROM part) END AS found FROM m")
def _(spark, d):
    return R.resolve_members(_members(spark, d), way_nodes(spark, d), nodes(spark, d))


@query("jon04_touching", f"WITH {WAY_NODES} SELECT DISTINCT id FROM way_nodes WHERE ref % 50 = 7")
def _(spark, d):
    return R.touching(way_nodes(spark, d), nodes(spark, d).where("id % 50 = 7"))


@query("jon06_regional_extract", f"WITH {WAY_NODES}, {NODES}, s AS (SELECT id FROM nodes WHERE x BETWEEN 20000 AND 40000 AND y BETWEEN 20000 AND 40000), w AS (SELECT DISTINCT id FROM way_nodes WHERE ref IN (SELECT id FROM s)) SELECT id FROM s UNION SELECT ref FROM way_nodes WHERE id IN (SELECT id FROM w)")
def _(spark, d):
    chosen = nodes(spark, d).where("x BETWEEN 20000 AND 40000 AND y BETWEEN 20000 AND 40000")
    return R.complete_nodes(way_nodes(spark, d), R.touching(way_nodes(spark, d), chosen), chosen)


@query("jon07_drop_blocked", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    blocked = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.drop_blocked(table(spark, d, "orders").select("o_orderkey", "o_custkey"), blocked, "o_custkey")


@query("jon08_attached_parts", "SELECT c_custkey, count(o_orderkey) AS n_parts, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, d):
    parts = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    found = R.attach_parts(table(spark, d, "customer").select("c_custkey"), parts, "c_custkey", "o_orderkey")
    return found.select("c_custkey", F.size("parts").cast("bigint").alias("n_parts"), F.aggregate("parts.o_orderkey", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("keys"))


@query("jon09_incomplete", "SELECT c_custkey, 'no parts' AS fault FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'no parent' FROM orders WHERE o_custkey % 10 = 3")
def _(spark, d):
    parents = table(spark, d, "customer").where("c_custkey % 10 <> 3").select("c_custkey")
    parts = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.incomplete(parents, parts, "c_custkey", F.col("c_custkey") % 2 == 0)


@query("jon11_site_of", f"WITH {MEMBERS} SELECT type, ref, min(relation) AS site FROM m GROUP BY type, ref")
def _(spark, d):
    return R.site_of(_members(spark, d))


@query("jon12_source_id_match", "SELECT c_custkey AS a_id, s_suppkey AS b_id FROM customer JOIN supplier ON CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS VARCHAR) = regexp_extract(s_name, '#0*([0-9]+)$', 1) WHERE regexp_extract(c_name, '#0*([0-9]+)$', 1) <> ''")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("record"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("record"))
    return R.match_by_source_id(a, b, "#0*([0-9]+)$")


@query("jon26_interval_join", f"WITH {WAY_NODES}, r AS (SELECT id, (seq - 1) * 10 AS lo, seq * 10 AS hi, ref AS value FROM way_nodes), s AS (SELECT id, seq * 7 - 7 AS lo, seq * 7 AS hi FROM way_nodes) SELECT s.id, s.lo, s.hi, r.value FROM s LEFT JOIN r ON r.id = s.id AND s.lo >= r.lo AND s.lo < r.hi")
def _(spark, d):
    w, q = way_nodes(spark, d), F.col("seq")
    return R.interval_join(w.select("id", (q * 7 - 7).alias("lo"), (q * 7).alias("hi")), w.select("id", ((q - 1) * 10).alias("lo"), (q * 10).alias("hi"), F.col("ref").alias("value")))


@query("jon31_overrides", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    edits = parts.where("p_partkey % 9 = 0").withColumn("p_size", F.col("p_size") + 100)
    return R.apply_overrides(parts, edits, "p_partkey", ["p_size"])[0]


@query("jon33_filled", "SELECT p_partkey, p_retailprice FROM part")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    holes = parts.withColumn("p_retailprice", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")))
    return R.fill_missing(holes, parts.where("p_partkey % 3 = 0"), "p_partkey", "p_retailprice")[0]


@query("jon40_anchors", "SELECT p_partkey AS id FROM part WHERE p_name = 'small ring' OR p_brand = 'small ring'")
def _(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("tags"))
    return R.anchors(e, ["name", "brand", "alt_name"], "small ring").select("id")


@query("agg04_evidence_counts", "SELECT dimension, basis, count(*) AS n FROM (SELECT 'flag' AS dimension, l_returnflag AS basis FROM lineitem UNION ALL SELECT 'status', l_linestatus FROM lineitem) GROUP BY ALL")
def _(spark, d):
    return A.evidence_counts(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")), ["flag", "status"])


@query("agg05_limit_ledger", "SELECT event_type AS code, count(*) AS n, max(value) AS actual, bool_or(value > 49) AS refused FROM events GROUP BY event_type")
def _(spark, d):
    return A.limit_ledger(table(spark, d, "events").select(F.col("event_type").alias("code"), F.col("value").alias("actual"), (F.col("value") > 49).alias("refused")))


@query("agg06_vote", "SELECT l_suppkey, CAST(max_by(q, w * 1000 + q) AS BIGINT) AS q, CAST(max(w) AS BIGINT) AS weight FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) % 7 AS q, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def _(spark, d):
    q = F.col("l_quantity").cast("bigint")
    return A.vote(table(spark, d, "lineitem").select("l_suppkey", (q % 7).alias("q"), q.alias("w")), "l_suppkey", "q", "w")


@query("agg07_neighbour_median", f"WITH {HOMES}, {SHOPS}, n AS (SELECT h.id, CAST(s.id % 40 AS DOUBLE) AS h FROM homes h JOIN shops s ON (h.x - s.x) * (h.x - s.x) + (h.y - s.y) * (h.y - s.y) <= 1000000) SELECT id, CASE WHEN count(*) >= 3 THEN median(h) END AS median, count(*) AS n, count(*) >= 3 AND bool_and(h < 12) AS all_low FROM n GROUP BY id")
def _(spark, d):
    near = P.within_distance(homes(spark, d), shops(spark, d), 1000)
    return A.neighbour_median(near.select(F.col("a_id").alias("id"), (F.col("b_id") % 40).cast("double").alias("h")))


@query("agg09_complexes", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def _(spark, d):
    return A.complexes(table(spark, d, "orders"), "o_custkey")


@query("agg11_weighted_mean", "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return A.weighted_mean(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity").select("l_suppkey", F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("agg12_group_records", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT CAST(l_partkey % 9 AS VARCHAR))), ',') AS sources, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS names, bool_or(l_tax > 0.07) AS flag FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.array((F.col("l_partkey") % 9).cast("string")).alias("sources"), F.array("l_returnflag").alias("names"), (F.col("l_tax") > 0.07).alias("flag"))
    return A.group_records(rows, "l_suppkey", "sources", "names", "flag").select("l_suppkey", F.array_join("sources", ",").alias("sources"), F.array_join("names", ",").alias("names"), "flag")


@query("agg16_distribution", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)")
def _(spark, d):
    return table(spark, d, "part").rollup("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("agg27_uncovered", "SELECT c_custkey AS id, 'lost' AS fault FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey % 4 <> 0")
def _(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return A.uncovered(ids, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), ids.where("id % 4 = 0"))


@query("agg30_majority", "SELECT l_partkey, min_by(f, -w * 10 + CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS f, array_to_string(list_sort(list(f)), ',') AS covering FROM (SELECT l_partkey, l_returnflag AS f, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("bigint").alias("w"))
    return A.majority(rows, "l_partkey", "f", "w").withColumn("covering", F.array_join("covering", ","))


@query("agg31_pair_lengths", "SELECT least(l_suppkey, l_partkey % 20) AS lo, greatest(l_suppkey, l_partkey % 20) AS hi, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length FROM lineitem GROUP BY ALL HAVING sum(CAST(l_quantity AS BIGINT)) >= 50")
def _(spark, d):
    return A.pair_lengths(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 20).alias("b"), F.col("l_quantity").cast("bigint").alias("length")), 50)


@query("agg32_lineage", "SELECT source, min(o_orderkey) AS first, count(*) AS n FROM (SELECT o_orderkey, unnest([o_custkey, -1 - o_orderkey % 5]) AS source FROM orders) GROUP BY source")
def _(spark, d):
    return A.lineage(table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.array("o_custkey", -1 - F.col("o_orderkey") % 5).alias("sources")))


@query("top01_name_lookup", "SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name), 'ring')) ORDER BY rank, p_name, p_partkey LIMIT 32")
def _(spark, d):
    name = F.lower("p_name")
    rank = F.when(name == "ring", 0).when(name.startswith("ring"), 1).otherwise(2)
    return table(spark, d, "part").where(name.contains("ring")).select("p_partkey", "p_name", rank.alias("rank")).orderBy("rank", "p_name", "p_partkey").limit(32)


@query("top03_most_expensive_cells", f"WITH {NODES} SELECT x // 10000 AS cx, y // 10000 AS cy, count(*) AS n FROM nodes GROUP BY ALL ORDER BY n DESC, cx, cy LIMIT 16")
def _(spark, d):
    cells = nodes(spark, d).groupBy(F.floor(F.col("x") / 10000).alias("cx"), F.floor(F.col("y") / 10000).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), "cx", "cy").limit(16)


@query("top04_poi_per_name", "SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1 ORDER BY p_size DESC, p_name, p_partkey LIMIT 400")
def _(spark, d):
    one = S.best(table(spark, d, "part"), ["p_name"], F.desc("p_size"), F.col("p_partkey"))
    return one.select("p_name", "p_partkey", "p_size").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(400)


def _edited(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    kept = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o, kept.unionByName(o.where("o_orderkey % 13 = 0").withColumn("o_orderkey", -1 - k))


AFTER = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders), a AS (SELECT k, c, CASE WHEN k % 7 = 0 THEN 'X' ELSE s END AS s FROM o WHERE k % 11 <> 0 UNION ALL SELECT -1 - k, c, s FROM o WHERE k % 13 = 0)"


@query("set04_diff", f"WITH {AFTER} SELECT coalesce(o.k, a.k) AS o_orderkey, CASE WHEN o.k IS NULL THEN 'insert' WHEN a.k IS NULL THEN 'delete' ELSE 'update' END AS kind, o.s AS before_status, a.s AS after_status FROM o FULL JOIN a ON o.k = a.k WHERE o.k IS NULL OR a.k IS NULL OR o.s <> a.s OR o.c <> a.c")
def _(spark, d):
    return C.diff(*_edited(spark, d), "o_orderkey").select("o_orderkey", "kind", F.col("before.o_orderstatus").alias("before_status"), F.col("after.o_orderstatus").alias("after_status"))


@query("set05_apply", f"WITH {AFTER} SELECT k AS o_orderkey, c AS o_custkey, s AS o_orderstatus FROM a")
def _(spark, d):
    before, after = _edited(spark, d)
    return C.apply_changes(before, C.diff(before, after, "o_orderkey"), "o_orderkey")[0]


@query("set06_undo", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, d):
    before, after = _edited(spark, d)
    return C.apply_changes(after, C.reverse(C.diff(before, after, "o_orderkey")), "o_orderkey")[0]


@query("set07_coalesce", "SELECT user_id, min_by(value, event_id) AS before, max_by(value + 1, event_id) AS after FROM events GROUP BY user_id HAVING min_by(value, event_id) <> max_by(value + 1, event_id)")
def _(spark, d):
    return C.coalesce(table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("before"), (F.col("value") + 1).alias("after")), "user_id", "event_id")


@query("set08_key_sets", "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 10 <> 4) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey % 10 = 3")
def _(spark, d):
    return C.key_set_differences(table(spark, d, "customer").select(F.col("c_custkey").alias("k")).where("k % 10 <> 3"), table(spark, d, "orders").select(F.col("o_custkey").alias("k")).where("k % 10 <> 4"), "k")


@query("set10_regenerate", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS g FROM orders), j AS (SELECT k, g, CASE WHEN k % 17 = 0 THEN 'deleted' WHEN k % 29 = 0 THEN 'edited' ELSE 'same' END AS st FROM o), f AS (SELECT g, bool_or(st = 'edited') AS frozen FROM j GROUP BY g) SELECT k AS id, CASE WHEN st = 'deleted' THEN 'tombstone' WHEN frozen THEN 'keep' ELSE 'replace' END AS action FROM j JOIN f USING (g) UNION ALL SELECT -1 - k, 'add' FROM j JOIN f USING (g) WHERE k % 5 = 0 AND NOT frozen")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.col("o_orderstatus").alias("image"))
    current = o.where("id % 17 <> 0").withColumn("image", F.when(F.col("id") % 29 == 0, "edited").otherwise(F.col("image")))
    fresh = o.where("id % 5 = 0").withColumn("id", -1 - F.col("id"))
    return C.regenerate(o, current, fresh, "id", "grp", "image")


@query("prj30_precedence", "SELECT p_partkey, coalesce(a, b, c, 10) AS height, CASE WHEN a IS NOT NULL THEN 'author' WHEN b IS NOT NULL THEN 'source' WHEN c IS NOT NULL THEN 'auxiliary' ELSE 'context' END AS height_basis FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size + 2 END AS b, CASE WHEN p_partkey % 2 = 0 THEN p_size + 3 END AS c FROM part)")
def _(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    found = C.resolve("height", ("author", F.when(k % 7 == 0, s + 1)), ("source", F.when(k % 3 == 0, s + 2)), ("auxiliary", F.when(k % 2 == 0, s + 3)), ("context", F.lit(10)))
    return table(spark, d, "part").select("p_partkey", *found)


@query("prj33_rejected", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'size' WHEN p_retailprice < 950 THEN 'price' END AS reason FROM part WHERE p_size > 45 OR p_retailprice < 950")
def _(spark, d):
    return C.split(table(spark, d, "part"), ("size", F.col("p_size") > 45), ("price", F.col("p_retailprice") < 950))[1].select("p_partkey", "reason")


def _graph(spark, d):
    """All orders as edges between a customer and a run of 37 orders."""
    return table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.floor(F.col("o_orderkey") / 37) * 2 + 1).alias("b"))


GRAPH = "e AS (SELECT o_custkey * 2 AS a, o_orderkey // 37 * 2 + 1 AS b FROM orders)"


_BOTH = f"{GRAPH}, s(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"
_LABELS = "r(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, min(r.label) FROM r JOIN s ON s.a = r.node JOIN recurring.r AS old ON old.node = s.b WHERE r.label < old.label GROUP BY s.b)"


@query("gra02_components", f"WITH RECURSIVE {_BOTH}, {_LABELS} SELECT node, label AS component FROM r")
def _(spark, d):
    return GR.components(_graph(spark, d))


@query("gra01_closure", f"WITH RECURSIVE {WAY_NODES}, i AS (SELECT DISTINCT id AS way, ref AS node FROM way_nodes), r(way, hop) USING KEY (way) AS (SELECT DISTINCT way, 0 FROM i WHERE way % 997 = 1 UNION SELECT DISTINCT q.way, r.hop + 1 FROM r JOIN i p ON p.way = r.way JOIN i q ON q.node = p.node LEFT JOIN recurring.r AS old ON old.way = q.way WHERE r.way % 5 = 0 AND old.way IS NULL) SELECT way, hop FROM r")
def _(spark, d):
    inc = way_nodes(spark, d).select(F.col("id").alias("way"), F.col("ref").alias("node"))
    ways = inc.select("way").distinct()
    return GR.closure(ways.where("way % 997 = 1"), inc, ways.where("way % 5 = 0"))


def _ends(spark, d):
    ends = way_nodes(spark, d).groupBy(F.col("id").alias("edge")).agg(F.min_by("ref", "seq").alias("a"), F.max_by("ref", "seq").alias("b"))
    return ends.select("edge", *[(F.col(c) * 8 + F.col("edge") % 8).alias(c) for c in "ab"])


@query("gra13_two_arm_joins", f"WITH {WAY_NODES}, w AS (SELECT id, min_by(ref, seq) * 8 + id % 8 AS a, max_by(ref, seq) * 8 + id % 8 AS b FROM way_nodes GROUP BY id), h AS (SELECT id, unnest([a, b]) AS node FROM w) SELECT node, min(id) AS lo, max(id) AS hi FROM h GROUP BY node HAVING count(*) = 2 AND min(id) <> max(id)")
def _(spark, d):
    return GR.two_arm_joins(_ends(spark, d))


@query("gra03_chains", f"WITH RECURSIVE {WAY_NODES}, w AS (SELECT id, min_by(ref, seq) * 8 + id % 8 AS a, max_by(ref, seq) * 8 + id % 8 AS b FROM way_nodes GROUP BY id), h AS (SELECT id, unnest([a, b]) AS node FROM w), l AS (SELECT min(id) AS a, max(id) AS b FROM h GROUP BY node HAVING count(*) = 2 AND min(id) <> max(id) AND min(id % 2) = max(id % 2)), s(a, b) AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_LABELS} SELECT id AS edge, coalesce(label, id) AS chain FROM w LEFT JOIN r ON r.node = w.id")
def _(spark, d):
    return GR.chains(_ends(spark, d).withColumn("lanes", F.col("edge") % 2), "lanes")


@query("gra14_routes", f"WITH {GRAPH}, p AS (SELECT DISTINCT a AS start, a + 2 AS goal FROM e), h AS (SELECT DISTINCT f.a AS start, t.a AS node FROM e f JOIN e t ON f.b = t.b), two AS (SELECT start, goal FROM p JOIN h USING (start) WHERE node = goal), four AS (SELECT DISTINCT p.start, p.goal FROM p JOIN h x ON x.start = p.start JOIN h y ON y.start = p.goal AND y.node = x.node) SELECT start, goal, CASE WHEN (start, goal) IN (SELECT (start, goal) FROM two) THEN 2 ELSE 4 END AS hops FROM four")
def _(spark, d):
    g = _graph(spark, d)
    pairs = g.select(F.col("a").alias("start"), (F.col("a") + 2).alias("goal")).distinct()
    return GR.route(g, pairs, 4)


@query("gra15_distances", f"WITH RECURSIVE {GRAPH}, s AS (SELECT a AS u, b AS v, a % 7 + 1 AS length FROM e UNION SELECT b, a, a % 7 + 1 FROM e), r(node, distance) AS (SELECT DISTINCT a, 0 FROM e WHERE a % 100 = 0 UNION SELECT v, distance + length FROM r JOIN s ON u = node WHERE distance + length <= 20) SELECT node, CAST(min(distance) AS DOUBLE) AS distance FROM r GROUP BY node")
def _(spark, d):
    g = _graph(spark, d).withColumn("length", (F.col("a") % 7 + 1).cast("double"))
    return GR.distances(g, g.where("a % 100 = 0").select(F.col("a").alias("node")), 20.0)


@query("str01_throttled", "WITH e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS z, row_number() OVER (PARTITION BY user_id, event_type, epoch_us(ts) // 3600000000 ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT event_id, user_id, event_type FROM e WHERE a = 1 OR z = 1 OR b = 1")
def _(spark, d):
    from geoloom.streaming.progress import throttled

    return throttled(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3600.0).select("event_id", "user_id", "event_type")


@query("str02_contiguity", "SELECT event_id, user_id FROM (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS seq FROM events)) WHERE p + 1 <> seq")
def _(spark, d):
    from pyspark.sql import Window

    from geoloom.streaming.progress import sequence_faults

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + F.when(F.col("event_id") % 31 == 0, 1).otherwise(0)
    return sequence_faults(table(spark, d, "events").withColumn("seq", seq), "user_id", "seq", "event_id").select("event_id", "user_id")
