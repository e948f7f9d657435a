"""Relations of ways as polygons and regions: a relation for every supplier, split into ways, some of them faulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import polygons as G
from geoloom.plans.base import query, table

#: Corners of an octagon and of the square in it; no side is parallel to an axis. Fixed values of the fixture, as the SQL has them.
OUTER = ((410, 13), (283, 290), (-11, 400), (-290, 277), (-405, -9), (-275, -288), (17, -395), (288, -281))
INNER = ((100, 7), (-9, 103), (-104, -5), (3, -98))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("bigint")
    return table(spark, d, "supplier").select(k.alias("k"), (k % 100 * 3000).alias("cx"), (F.floor(k / 100) * 3000).alias("cy"))


def _corner(j: int):
    """Node of the octagon's corner j: numbers run along it in even relations and against it in odd ones."""
    k = F.col("k")
    return k * 100 + F.when(k % 2 == 0, j * 3 % 8).otherwise(j * 5 % 8)


def relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """members, ways, way_nodes and nodes. By k % 7: 1 lacks a way, 2 lists a missing way, 3 lists a way of k - 1 too, 4 has its hole outside, 5 has its hole touch."""
    base = _placed(spark, d)
    k, kind = F.col("k"), F.col("k") % 7
    shift = F.when(kind == 4, 1000).otherwise(0)
    corner = [F.struct(_corner(j).alias("id"), (F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y")) for j, (x, y) in enumerate(OUTER)]
    for j, (x, y) in enumerate(INNER):
        touch = (kind == 5) & F.lit(j == 0)
        corner.append(F.struct((k * 100 + 50 + j).alias("id"), (F.col("cx") + shift + F.when(touch, OUTER[0][0]).otherwise(x)).alias("x"), (F.col("cy") + F.when(touch, OUTER[0][1]).otherwise(y)).alias("y")))
    nodes = base.select(F.explode(F.array(*corner)).alias("n")).select("n.*")
    inner = [k * 100 + 50 + j for j in (0, 1, 2, 3, 0)]
    parts = [[_corner(j) for j in (0, 1, 2, 3)], [_corner(j) for j in (6, 5, 4, 3)], [_corner(j) for j in (6, 7, 0)], inner]
    lines = base.select(F.explode(F.array(*[F.struct((k * 10 + i).alias("id"), F.array(*p).alias("nodes")) for i, p in enumerate(parts)])).alias("w")).select("w.*")
    way_nodes = lines.select("id", F.posexplode("nodes").alias("seq", "ref")).withColumn("seq", F.col("seq") + 1)
    listed = F.array(k * 10, k * 10 + 1, F.when(kind == 1, None).otherwise(k * 10 + 2), k * 10 + 3, F.when(kind == 2, -k), F.when(kind == 3, (k - 1) * 10))
    tags = F.create_map(F.lit("natural"), F.lit("water"))
    members = base.select(k.alias("relation"), F.posexplode(listed).alias("pos", "ref"), tags.alias("tags")).where("ref IS NOT NULL")
    members = members.select("relation", "pos", F.lit("way").alias("type"), "ref", F.when(F.col("pos") == 3, "inner").otherwise("outer").alias("role"), "tags")
    ways = lines.select("id", F.when(F.col("id") % 10 == 0, tags).alias("tags"), F.lit(None).cast("string").alias("kind"))
    return members, ways, way_nodes, nodes


def _polygons(spark: SparkSession, d: str):
    return G.relation_polygons(*relations(spark, d), cell=500)


# A relation k shares its first way with k + 1 where that one lists it, which costs k + 1 its polygon, not k.
SOUND = "sound AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier WHERE s_suppkey % 7 IN (0, 6))"
FAULTS = "SELECT k AS relation, fault FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, s_suppkey % 7 AS m FROM supplier) JOIN (VALUES (1, 'open'), (2, 'missing way'), (4, 'hole outside'), (5, 'rings meet')) f(m, fault) USING (m) UNION ALL SELECT CAST(s_suppkey AS BIGINT), CASE WHEN s_suppkey = 1 OR NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey = a.s_suppkey - 1) THEN 'missing way' ELSE 'shared member' END FROM supplier a WHERE s_suppkey % 7 = 3"


@query("gra07_relation_polygons", f"WITH {SOUND}, o AS (SELECT k, 'outer' AS role, CAST(k * 10 AS BIGINT) AS ring, CAST(NULL AS BIGINT) AS parent, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS seq FROM sound), i AS (SELECT k, 'inner' AS role, CAST(k * 10 + 3 AS BIGINT) AS ring, CAST(k * 10 AS BIGINT) AS parent, unnest([0, 1, 2, 3]) AS seq FROM sound) SELECT k AS relation, role, ring, parent, CAST(seq AS BIGINT) AS seq, k * 100 + (CASE WHEN k % 2 = 0 THEN [0, 3, 6, 1, 4, 7, 2, 5] ELSE [0, 3, 6, 1, 4, 7, 2, 5] END)[seq + 1] AS node FROM o UNION ALL SELECT k, role, ring, parent, CAST(seq AS BIGINT), k * 100 + 50 + seq FROM i")
def _(spark, d):
    return _polygons(spark, d)[0].select("relation", "role", "ring", "parent", "seq", "node")


@query("gra07_relation_faults", FAULTS)
def _(spark, d):
    return _polygons(spark, d)[1]


@query("gra07_consumed_ways", f"WITH {SOUND} SELECT k * 10 + unnest([0, 1, 2, 3]) AS way, k AS relation FROM sound")
def _(spark, d):
    return _polygons(spark, d)[2]


@query("gra07_long_ring", "WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT 1 AS relation, CAST(i AS BIGINT) AS seq, CAST(i AS BIGINT) AS node FROM c")
def _(spark, d):
    """One relation whose ring is all customers: each is a way from a place to the next, every third drawn backward."""
    keys = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("_n"))
    both = table(spark, d, "customer").join(F.broadcast(keys)).select((F.col("c_custkey").cast("bigint") % F.col("_n")).alias("i"), "_n")
    ends = [F.col("i"), (F.col("i") + 1) % F.col("_n")]
    way = (F.col("i") * 7919) % 2_147_483_647
    order = F.when(F.col("i") % 3 == 0, F.array(*ends[::-1])).otherwise(F.array(*ends))
    lines = both.select(way.alias("id"), F.posexplode(order).alias("seq", "ref")).withColumn("seq", F.col("seq") + 1)
    members = both.select(F.lit(1).alias("group"), way.alias("way"))
    return G.ring_vertices(members, lines)[0].select(F.col("group").alias("relation"), "seq", "node")


# Even-odd rule in SQL, in whole numbers.
IN_RING = "SELECT h.id, e.k, count(*) FILTER (WHERE (e.y > h.y) <> (e.y2 > h.y) AND CASE WHEN e.y2 > e.y THEN (e.x2 - e.x) * (h.y - e.y) - (h.x - e.x) * (e.y2 - e.y) > 0 ELSE (e.x2 - e.x) * (h.y - e.y) - (h.x - e.x) * (e.y2 - e.y) < 0 END) AS n, bool_or((e.x2 - e.x) * (h.y - e.y) = (h.x - e.x) * (e.y2 - e.y) AND h.x BETWEEN least(e.x, e.x2) AND greatest(e.x, e.x2) AND h.y BETWEEN least(e.y, e.y2) AND greatest(e.y, e.y2)) AS \"on\" FROM towns h JOIN edges e ON h.x BETWEEN e.cx - 2000 AND e.cx + 2000 AND h.y BETWEEN e.cy - 2000 AND e.cy + 2000 GROUP BY h.id, e.k"
_LIST = lambda corners: "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in corners) + "]"
REGION = f"""WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_suppkey % 100 * 3000 AS cx, s_suppkey // 100 * 3000 AS cy FROM supplier WHERE s_suppkey % 7 NOT IN (1, 2)),
rings AS (SELECT k, cx, cy, 0 AS dx, {_LIST(OUTER)} AS p, unnest(range(8)) AS i FROM s UNION ALL SELECT k, cx, cy, CASE WHEN k % 7 = 4 THEN 1000 ELSE 0 END, {_LIST(INNER)}, unnest(range(4)) FROM s),
turned AS (SELECT k, cx, cy, dx, i, len(p) AS n, CASE WHEN k % 7 = 5 AND len(p) = 4 THEN list_prepend({{'x': {OUTER[0][0]}, 'y': {OUTER[0][1]}}}, p[2:]) ELSE p END AS p FROM rings),
edges AS (SELECT k, cx, cy, cx + dx + p[i + 1].x AS x, cy + p[i + 1].y AS y, cx + dx + p[(i + 1) % n + 1].x AS x2, cy + p[(i + 1) % n + 1].y AS y2 FROM turned),
towns AS (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey // 15) % 100 * 3000 + c_custkey * 37 % 900 - 450 AS x, c_custkey // 1500 * 3000 + c_custkey * 53 % 900 - 450 AS y FROM customer),
hits AS ({IN_RING})
"""


def _towns(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey").cast("bigint")
    x, y = F.floor(c / 15) % 100 * 3000 + c * 37 % 900 - 450, F.floor(c / 1500) * 3000 + c * 53 % 900 - 450
    return table(spark, d, "customer").select(c.alias("id"), x.alias("x"), y.alias("y"))


def _boundaries(spark: SparkSession, d: str):
    members, _, way_nodes, nodes = relations(spark, d)
    own = members.where("NOT (relation % 7 = 3 AND pos = 5)")  # boundaries may share ways, but not these
    return G.boundary_edges(own.withColumn("role", F.when(F.col("pos") == 0, "").otherwise(F.col("role"))), way_nodes, nodes)


@query("gra08_in_region", REGION + "SELECT id, x, y FROM towns WHERE id IN (SELECT id FROM hits WHERE \"on\" OR n % 2 = 1)")
def _(spark, d):
    return G.in_region(_towns(spark, d), _boundaries(spark, d)[0], 500)


@query("gra08_boundary_faults", "SELECT CAST(s_suppkey AS BIGINT) AS relation, CASE s_suppkey % 7 WHEN 1 THEN 'open' ELSE 'incomplete' END AS fault FROM supplier WHERE s_suppkey % 7 IN (1, 2)")
def _(spark, d):
    return _boundaries(spark, d)[1]
