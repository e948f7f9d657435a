"""Queries over road semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import roads as R
from geoloom.operators import sequences as S
from geoloom.operators import spatial as P
from geoloom.plans.base import ARCS, HOMES, NEAR_SEGS, SHOPS, WAY_NODES, homes, lines, near_lines, query, shops, table, way_nodes
from geoloom.plans.space import _BOTH, _LABELS, _graph


@query("prj21_dimensions", "WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40) / 2.0::DOUBLE + 1 END AS w, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 5 + 1 AS INTEGER) END AS l FROM orders), b AS (SELECT *, w IS NOT NULL AND (l IS NULL OR greatest(0.2, w - 0.5) / l > 4.5) AS byw FROM t) SELECT id, CAST(CASE WHEN byw THEN least(greatest(coalesce(l, 1), CAST(round_even(greatest(0.2, w - 0.5) / 3.25, 0) AS INTEGER)), 16) ELSE coalesce(l, 2) END AS INTEGER) AS lanes, CASE WHEN byw THEN 'width' WHEN l IS NOT NULL THEN 'lanes' ELSE 'class' END AS basis FROM b")
def _(spark, d):
    k = F.col("o_orderkey")
    w, n = F.when(k % 3 == 0, (k % 40) / 2.0 + 1), F.when(k % 2 == 0, (k % 5 + 1).cast("int"))
    _, count, _, basis = R.dimensions(w, n, F.lit(0.5), F.lit(2))
    return table(spark, d, "orders").select(k.alias("id"), count.cast("int").alias("lanes"), basis.alias("basis"))


@query("jon46_fitted_lanes", f"WITH {HOMES}, {SHOPS}, g AS (SELECT h.id, sqrt(CAST((h.x - s.x) ** 2 + (h.y - s.y) ** 2 AS DOUBLE)) / 40 AS distance FROM homes h JOIN shops s ON (h.x - s.x) ** 2 + (h.y - s.y) ** 2 <= 250000), n AS (SELECT id, min(distance) AS near FROM g GROUP BY id) SELECT h.id, CAST(h.id % 4 + 1 AS INTEGER) AS lanes, CAST(CASE WHEN h.id % 5 = 0 OR near IS NULL THEN h.id % 4 + 1 ELSE greatest(1, least(h.id % 4 + 1, CAST(floor((greatest(0, 2 * (near - 1.0)) - 0.5) / 3.25) AS INTEGER))) END AS INTEGER) AS fitted FROM homes h LEFT JOIN n ON n.id = h.id")
def _(spark, d):
    gaps = P.within_distance(homes(spark, d), shops(spark, d), 500).select(F.col("a_id").alias("id"), (F.sqrt(F.col("d2").cast("double")) / 40).alias("distance"))
    rows = homes(spark, d).select("id", (F.col("id") % 4 + 1).cast("int").alias("lanes"), (F.col("id") % 5 == 0).alias("tagged"))
    return R.fitted_lanes(rows, gaps, 1.0).select("id", "lanes", F.col("fitted").cast("int").alias("fitted"))


@query("jon21_unshared_crossings", f"WITH {NEAR_SEGS}, s AS (SELECT * FROM segs) SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.id < b.id AND greatest(a.x, a.x2) >= least(b.x, b.x2) AND greatest(b.x, b.x2) >= least(a.x, a.x2) WHERE sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0 AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0 AND NOT EXISTS (SELECT 1 FROM way_nodes p JOIN way_nodes q ON p.ref = q.ref WHERE p.id = a.id AND q.id = b.id)")
def _(spark, d):
    found = P.crossings(S.segments(near_lines(spark, d)), 250)
    return R.unshared(found, way_nodes(spark, d)).select("a_id", "b_id").distinct()


@query("prj17_vertical_faults", f"WITH {WAY_NODES}, v AS (SELECT id, CASE WHEN id % 3 = 0 OR (id % 5 = 0 AND ref % 2 = 0) THEN ref END AS ele FROM way_nodes), n AS (SELECT id, count(*) AS n, count(ele) AS e, max(abs(ele)) AS top FROM v GROUP BY id) SELECT id, fault FROM (SELECT id, CASE WHEN e > 0 AND e < n THEN 'partial' WHEN id % 7 = 0 AND e = 0 THEN 'no heights' WHEN top > 10000 THEN 'range' END AS fault FROM n) WHERE fault IS NOT NULL")
def _(spark, d):
    w = way_nodes(spark, d)
    k = F.col("id")
    ways = w.select("id").distinct().withColumn("kind", F.when(k % 7 == 0, "bridge").otherwise("ground"))
    return R.vertical_faults(ways, w.select("id", F.when((k % 3 == 0) | ((k % 5 == 0) & (F.col("ref") % 2 == 0)), F.col("ref")).alias("ele")))


@query("agg29_junction_arms", f"WITH {WAY_NODES} SELECT ref AS node, count(*) AS n, CASE WHEN count(*) > 32 THEN 'too many' WHEN min(id % 40) <> max(id % 40) THEN 'clearance' END AS fault FROM way_nodes GROUP BY ref")
def _(spark, d):
    return R.junction_arms(way_nodes(spark, d).select(F.col("ref").alias("node"), F.col("id").alias("way"), (F.col("id") % 40).alias("clearance"))).select("node", "n", "fault")


@query("win16_end_clearances", f"WITH {WAY_NODES}, m AS (SELECT id, min_by(ref, seq) * 8 + id % 8 AS a, max_by(ref, seq) * 8 + id % 8 AS b FROM way_nodes GROUP BY id), e AS (SELECT id, 0 AS \"end\", a AS node FROM m UNION ALL SELECT id, 1, b FROM m) SELECT id, \"end\", CASE WHEN count(*) OVER (PARTITION BY node) = 1 THEN 2.5 ELSE 8.0 END::DOUBLE AS clear FROM e")
def _(spark, d):
    m = way_nodes(spark, d).groupBy("id").agg(F.min_by("ref", "seq").alias("a"), F.max_by("ref", "seq").alias("b"))
    ends = m.select("id", F.posexplode(F.array(*[F.col(c) * 8 + F.col("id") % 8 for c in "ab"])).alias("end", "node"))
    return R.end_clearances(ends, 2.5, 8.0)


@query("win19_ramps", f"WITH {ARCS} SELECT id, seq, round(least(600.0, \"at\" * 0.08, (total - \"at\") * 0.08), 4) AS z FROM arcs")
def _(spark, d):
    return R.ramp_profile(S.arc_length(S.segments(lines(spark, d))), 600.0, 0.08).select("id", "seq", F.round("z", 4).alias("z"))


@query("prj42_source_heights", "SELECT p_partkey, CASE WHEN h IS NOT NULL AND (l IS NULL OR h >= 2.6 * l) THEN h ELSE l * 3.0 END::DOUBLE AS metres, CASE WHEN h IS NOT NULL AND (l IS NULL OR h >= 2.6 * l) THEN 'height' WHEN l IS NOT NULL THEN 'levels' END AS basis FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS h, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 12 END AS l FROM part)")
def _(spark, d):
    k = F.col("p_partkey")
    metres, basis = R.source_heights(F.when(k % 3 != 0, F.col("p_size").cast("double")), F.when(k % 2 == 0, k % 12))
    return table(spark, d, "part").select("p_partkey", metres.cast("double").alias("metres"), basis.alias("basis"))


@query("set11_regrouped", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey) THEN CAST(o_custkey AS VARCHAR) ELSE 'r' || substr(sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), o_orderpriority)), 1, 12) END AS record FROM orders")
def _(spark, d):
    return R.regroup(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "r").select("o_custkey", "o_orderkey", "record")


@query("set03_id_sets", "SELECT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION SELECT -c_custkey FROM customer WHERE c_custkey % 7 = 0")
def _(spark, d):
    c = table(spark, d, "customer")
    used = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"))
    return used.subtract(c.where("c_custkey % 3 = 0").select("c_custkey")).union(c.where("c_custkey % 7 = 0").select((-F.col("c_custkey")).alias("id"))).distinct()


@query("agg28_grounded_components", f"WITH RECURSIVE {_BOTH}, {_LABELS} SELECT label AS component, count(*) AS grounded FROM r WHERE node % 5 = 0 GROUP BY label HAVING count(*) >= 2")
def _(spark, d):
    g = _graph(spark, d)
    return R.grounded_components(g, g.select(F.explode(F.array("a", "b")).alias("node")).where("node % 5 = 0"))
