"""Queries over vertex sequences, road graph aggregates and scalar geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import aggregates as A
from geoloom.operators import sequences as S
from geoloom.plans.base import ARCS, BOXES, LINES, NODES, SEGS, WAY_NODES, boxes, lines, nodes, query, table, way_nodes


@query("agg01_shared_nodes", f"WITH {WAY_NODES} SELECT ref, count(DISTINCT id) AS n_ways, count(*) AS arms FROM way_nodes GROUP BY ref HAVING count(DISTINCT id) >= 2")
def _(spark, d):
    return A.shared_nodes(way_nodes(spark, d))


@query("agg02_node_arms", f"WITH {WAY_NODES}, n AS (SELECT *, max(seq) OVER (PARTITION BY id) AS last FROM way_nodes) SELECT ref, CAST(sum(CASE WHEN seq = 1 OR seq = last THEN 1 ELSE 2 END) AS BIGINT) AS arms FROM n GROUP BY ref")
def _(spark, d):
    return A.node_arms(way_nodes(spark, d))


@query("agg03_envelopes", f"WITH {LINES} SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lines GROUP BY id")
def _(spark, d):
    return A.envelopes(lines(spark, d))


@query("win01_segments", f"WITH {SEGS} SELECT id, seq, x, y, x2, y2 FROM segs")
def _(spark, d):
    return S.segments(lines(spark, d))


@query("win01_ring_edges", f"WITH {LINES} SELECT id, seq, x, y, coalesce(lead(x) OVER w, first(x) OVER f) AS x2, coalesce(lead(y) OVER w, first(y) OVER f) AS y2 FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq), f AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(spark, d):
    return S.segments(lines(spark, d), closed=True)


@query("win02_arc_length", f"WITH {ARCS} SELECT id, seq, round(len, 3) AS len, round(\"at\", 3) AS \"at\", round(CASE WHEN total > 0 THEN \"at\" / total ELSE 0 END, 6) AS fraction FROM arcs")
def _(spark, d):
    return S.arc_length(S.segments(lines(spark, d))).select("id", "seq", F.round("len", 3).alias("len"), F.round("at", 3).alias("at"), F.round("fraction", 6).alias("fraction"))


@query(
    "win03_split_at_nodes",
    f"""WITH {LINES}, m AS (SELECT *, CASE WHEN ref % 7 = 0 AND seq > 1 AND seq < max(seq) OVER (PARTITION BY id) THEN 1 ELSE 0 END AS c FROM lines),
    p AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM m)
    SELECT id, CAST(piece AS BIGINT) AS piece, seq, ref FROM p UNION ALL SELECT id, CAST(piece + 1 AS BIGINT), seq, ref FROM p WHERE c = 1""",
)
def _(spark, d):
    cuts = nodes(spark, d).where("id % 7 = 0").select(F.col("id").alias("ref"))
    return S.split_at(lines(spark, d), cuts).select("id", F.col("piece").cast("bigint").alias("piece"), "seq", "ref")


@query("win04_drop_repeats", f"WITH {LINES}, s AS (SELECT id, seq, x // 20000 AS x, y // 20000 AS y FROM lines) SELECT id, seq, x, y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE px IS NULL OR px <> x OR py <> y")
def _(spark, d):
    coarse = lines(spark, d).select("id", "seq", F.floor(F.col("x") / 20000).alias("x"), F.floor(F.col("y") / 20000).alias("y"))
    return S.drop_repeats(coarse)


_RULES = f"{WAY_NODES}, n AS (SELECT id, seq, count(*) OVER (PARTITION BY id) AS k FROM way_nodes), r AS (SELECT id, (seq - 1) / CAST(k AS DOUBLE) AS lo, CASE WHEN id % 5 = 0 AND seq = 2 THEN (seq - 0.5) / k WHEN id % 7 = 0 AND seq = 1 THEN (seq + 0.5) / k ELSE seq / CAST(k AS DOUBLE) END AS hi, seq FROM n)"


def _rules(spark, d):
    n = way_nodes(spark, d).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("id")).cast("double"))
    hi = F.when((F.col("id") % 5 == 0) & (F.col("seq") == 2), (F.col("seq") - 0.5) / F.col("k")).when((F.col("id") % 7 == 0) & (F.col("seq") == 1), (F.col("seq") + 0.5) / F.col("k")).otherwise(F.col("seq") / F.col("k"))
    return n.select("id", ((F.col("seq") - 1) / F.col("k")).alias("lo"), hi.alias("hi"), "seq")


@query("win05_partition_faults", f"WITH {_RULES}, g AS (SELECT id, hi, lo - coalesce(lag(hi) OVER (PARTITION BY id ORDER BY lo, hi), 0) AS gap FROM r) SELECT id, fault FROM (SELECT id, CASE WHEN max(gap) > 0 THEN 'gap' WHEN min(gap) < 0 THEN 'overlap' WHEN max(hi) <> 1 THEN 'end' END AS fault FROM g GROUP BY id) WHERE fault IS NOT NULL")
def _(spark, d):
    return S.partition_faults(_rules(spark, d))


_SPANS = "spans AS (SELECT l_suppkey AS id, l_partkey % 1000 AS lo, l_partkey % 1000 + CAST(l_quantity AS BIGINT) % 9 AS hi FROM lineitem)"


@query(
    "win06_merge_intervals",
    f"""WITH {_SPANS}, f AS (SELECT *, CASE WHEN max(hi) OVER p IS NULL OR lo > max(hi) OVER p THEN 1 ELSE 0 END AS fresh FROM spans WINDOW p AS (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY lo, hi, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT id, min(lo) AS lo, max(hi) AS hi, count(*) AS parts FROM g GROUP BY id, island""",
)
def _(spark, d):
    lo = F.col("l_partkey") % 1000
    spans = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), lo.alias("lo"), (lo + F.col("l_quantity").cast("bigint") % 9).alias("hi"))
    return S.merge_intervals(spans)


@query("win07_best_per_key", "SELECT l_partkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    return S.best(table(spark, d, "lineitem"), ["l_partkey"], F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")).select("l_partkey", "l_orderkey", "l_extendedprice")


@query("win08_chunks", "SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 16 AS block FROM customer")
def _(spark, d):
    return S.chunk(table(spark, d, "customer"), ["c_nationkey"], 16, F.col("c_custkey")).select("c_nationkey", "c_custkey", F.col("block").cast("bigint").alias("block"))


@query("win09_stations_count", f"WITH {ARCS}, t AS (SELECT DISTINCT id, total FROM arcs) SELECT id, CAST(floor(total / 5000) + 1 AS BIGINT) AS n FROM t WHERE total > 0")
def _(spark, d):
    found = S.stations(S.arc_length(S.segments(lines(spark, d))), 5000.0)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("win09_stations", f"WITH {ARCS}, k AS (SELECT *, unnest(range(CAST(ceil(greatest(\"at\", 700) / 5000) AS BIGINT), CAST(floor(least(\"at\" + len, total - 700) / 5000) AS BIGINT) + 1)) AS k FROM arcs WHERE len > 0) SELECT id, k, CAST(k * 5000 AS DOUBLE) AS \"at\", round(x + (x2 - x) * (k * 5000 - \"at\") / len, 3) AS x, round(y + (y2 - y) * (k * 5000 - \"at\") / len, 3) AS y FROM k")
def _(spark, d):
    found = S.stations(S.arc_length(S.segments(lines(spark, d))), 5000.0, clear=700.0)
    return found.select("id", "k", "at", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("win10_morton", f"WITH {NODES} SELECT id, CAST((SELECT sum(((x // 3200 >> b) & 1) * (1::BIGINT << (2 * b)) + ((y // 3200 >> b) & 1) * (1::BIGINT << (2 * b + 1))) FROM range(0, 10) r(b)) AS BIGINT) AS code FROM nodes")
def _(spark, d):
    cell = lambda c: F.floor(F.col(c) / 3200)
    half = F.lit(1 << 9)
    return nodes(spark, d).select("id", G.morton(cell("x") - half, cell("y") - half, bits=10).alias("code"))


@query("win11_triples", f"WITH {WAY_NODES}, v AS (SELECT id, seq, ref % 3 AS v FROM way_nodes) SELECT id, seq, v FROM (SELECT *, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM v WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE v = b AND v = c")
def _(spark, d):
    return S.triples(way_nodes(spark, d).select("id", "seq", (F.col("ref") % 3).alias("v")), "id", "seq", "v")


@query("win14_capped", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 1009, c_custkey) AS n FROM customer) WHERE n <= 20")
def _(spark, d):
    return S.capped(table(spark, d, "customer"), ["c_mktsegment"], 20, (F.col("c_custkey") * 7919) % 1009, F.col("c_custkey")).select("c_mktsegment", "c_custkey")


@query("win17_corridor_faults", f"WITH {WAY_NODES}, s AS (SELECT id, seq, seq * 10 AS a, CASE WHEN ref % 11 = 0 THEN seq * 10 + 9 WHEN ref % 13 = 0 THEN seq * 10 ELSE seq * 10 + 10 END AS b FROM way_nodes) SELECT id, seq, fault FROM (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY id ORDER BY seq) <> a THEN 'gap' WHEN b <= a THEN 'backwards' END AS fault FROM s) WHERE fault IS NOT NULL")
def _(spark, d):
    a = F.col("seq") * 10
    b = F.when(F.col("ref") % 11 == 0, a + 9).when(F.col("ref") % 13 == 0, a).otherwise(a + 10)
    return S.corridor_faults(way_nodes(spark, d).select("id", "seq", a.alias("a"), b.alias("b")), "id", "seq", "a", "b").select("id", "seq", "fault")


@query("win18_turns", f"WITH {SEGS}, v AS (SELECT id, seq, x2 - x AS dx, y2 - y AS dy FROM segs) SELECT id, seq, dx * px + dy * py AS dot, px * dy - py * dx AS cross FROM (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM v WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE px IS NOT NULL")
def _(spark, d):
    return S.turns(S.segments(lines(spark, d)))


@query("jon27_value_at", f"WITH {WAY_NODES}, s AS (SELECT id, seq * 3 AS step, ref AS value FROM way_nodes), a AS (SELECT id, seq * 4 + 1 AS t FROM way_nodes) SELECT a.id, a.t, (SELECT max_by(s.value, s.step) FROM s WHERE s.id = a.id AND s.step <= a.t) AS value FROM a")
def _(spark, d):
    w = way_nodes(spark, d)
    return S.value_at(w.select("id", (F.col("seq") * 3).alias("at"), F.col("ref").alias("value")), w.select("id", (F.col("seq") * 4 + 1).alias("t"))).select("id", "t", "value")


@query("agg13_degrees", f"WITH {WAY_NODES}, e AS (SELECT ref AS a, lead(ref) OVER (PARTITION BY id ORDER BY seq) AS b FROM way_nodes), h AS (SELECT a AS node FROM e WHERE b IS NOT NULL UNION ALL SELECT b FROM e WHERE b IS NOT NULL) SELECT degree, count(*) AS nodes FROM (SELECT node, count(*) AS degree FROM h GROUP BY node) GROUP BY degree")
def _(spark, d):
    return A.degrees(A.edges(way_nodes(spark, d))).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("agg20_grades", f"WITH {ARCS}, g AS (SELECT id, abs((y2 - y) / 100.0) / len AS grade, len FROM arcs WHERE len > 0) SELECT id, round(max(grade), 6) AS max_grade, CAST(sum(CASE WHEN len >= 50000 THEN 1 ELSE 0 END) AS BIGINT) AS long_stretches FROM g GROUP BY id")
def _(spark, d):
    return A.grades(S.arc_length(S.segments(lines(spark, d))), F.col("y") / 100.0, F.col("y2") / 100.0, 50000.0).select("id", F.round("max_grade", 6).alias("max_grade"), "long_stretches")


@query("agg21_lengths", f"WITH {ARCS} SELECT id, round(sum(len), 3) AS length, count(*) AS segments FROM arcs GROUP BY id")
def _(spark, d):
    found = S.arc_length(S.segments(lines(spark, d))).groupBy("id").agg(F.sum("len").alias("length"), F.count(F.lit(1)).alias("segments"))
    return found.select("id", F.round("length", 3).alias("length"), "segments")


@query("sca01_seeded", "SELECT p_partkey, CAST(('0x' || substr(sha256(concat_ws(chr(31), 'storeys', CAST(p_partkey AS VARCHAR))), 1, 16))::UBIGINT % 97 AS BIGINT) AS high FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", G.seeded(97, F.lit("storeys"), F.col("p_partkey")).alias("high"))


@query("sca06_snap", f"WITH {NODES} SELECT id, CAST(sign(x - 50000) * floor(abs(x - 50000) / 320.0 + 0.5) * 320 AS BIGINT) AS x FROM nodes")
def _(spark, d):
    return nodes(spark, d).select("id", G.snap(F.col("x") - 50000, 320).alias("x"))


@query("sca07_scale", f"WITH {NODES} SELECT id, CAST(round(x / 3.0) AS BIGINT) AS x, CAST(round(y / 3.0) AS BIGINT) AS y FROM nodes")
def _(spark, d):
    return nodes(spark, d).select("id", G.scaled(F.col("x"), 3).alias("x"), G.scaled(F.col("y"), 3).alias("y"))


@query("sca08_clip", f"WITH {SEGS}, w AS (SELECT id, seq, x, y, x2, y2, CAST(x2 - x AS DOUBLE) AS dx, CAST(y2 - y AS DOUBLE) AS dy FROM segs WHERE x <> x2 AND y <> y2), t AS (SELECT id, seq, greatest(0, least((20000 - x) / dx, (80000 - x) / dx), least((30000 - y) / dy, (70000 - y) / dy)) AS t0, least(1, greatest((20000 - x) / dx, (80000 - x) / dx), greatest((30000 - y) / dy, (70000 - y) / dy)) AS t1 FROM w) SELECT id, seq, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE t0 <= t1")
def _(spark, d):
    s = S.segments(lines(spark, d)).where("x <> x2 AND y <> y2")
    t0, t1 = G.clip_interval(*[F.col(c) for c in ("x", "y", "x2", "y2")], *[F.lit(v) for v in (20000, 30000, 80000, 70000)])
    return s.select("id", "seq", F.round(t0, 6).alias("t0"), F.round(t1, 6).alias("t1")).where("t0 IS NOT NULL")


@query("sca09_orientation", f"WITH {LINES}, t AS (SELECT id, seq, x, y, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS by_, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq)) SELECT id, seq, CAST(sign((bx - x) * (cy - y) - (by_ - y) * (cx - x)) AS INTEGER) AS turn FROM t WHERE cx IS NOT NULL")
def _(spark, d):
    o = Window.partitionBy("id").orderBy("seq")
    t = lines(spark, d).select("id", "seq", "x", "y", *[F.lead(c, k).over(o).alias(f"{c}{k}") for k in (1, 2) for c in "xy"]).where("x2 IS NOT NULL")
    return t.select("id", "seq", G.orientation(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]).alias("turn"))


@query("sca10_ring_area", f"WITH {LINES}, e AS (SELECT id, x, y, coalesce(lead(x) OVER w, first(x) OVER f) AS x2, coalesce(lead(y) OVER w, first(y) OVER f) AS y2 FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq), f AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT id, CAST(sum(x * y2 - x2 * y) AS BIGINT) AS area2 FROM e GROUP BY id")
def _(spark, d):
    rings = lines(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return rings.select("id", G.ring_area2(F.col("p.x"), F.col("p.y")).alias("area2"))


@query("sca12_rectangles", f"WITH {BOXES} SELECT id, x1 > x0 AND y1 > y0 AS is_rectangle FROM boxes")
def _(spark, d):
    xs, ys = F.array("x0", "x1", "x1", "x0"), F.array("y0", "y0", "y1", "y1")
    return boxes(spark, d).select("id", G.is_axis_rectangle(xs, ys).alias("is_rectangle"))


@query("sca19_tile_names", "SELECT c_custkey, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || '_' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS tile FROM (SELECT c_custkey, c_custkey % 121 - 60 AS lat, c_custkey % 300 - 150 AS lon FROM customer)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", G.tile_name(F.col("c_custkey") % 300 - 150, F.col("c_custkey") % 121 - 60).alias("tile"))
