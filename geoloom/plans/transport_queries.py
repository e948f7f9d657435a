"""A road graph of all orders: ends and every third vertex are connectors, with rules of width and surface along each.

A line's tenth and later vertices share the connector names of the next line's, so names are repeated too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.operators import transport as X
from geoloom.operators.graph import written
from geoloom.plans.base import WAY_NODES, near_lines, query

#: Rules of each kind of segment: (kind of seven, layer, from, to, value). Kind 3 has a gap, kind 5 an overlap, kind 6 no surface. Fixed values of the fixture.
RULES = [(0, "width", 0.0, 1.0, 6), (1, "width", 0.0, 0.31, 6), (1, "width", 0.31, 1.0, 9), (2, "width", 0.0, 0.13, 5), (2, "width", 0.13, 0.77, 7), (2, "width", 0.77, 1.0, 5), (3, "width", 0.0, 0.43, 5), (3, "width", 0.53, 1.0, 5), (5, "width", 0.0, 0.63, 4), (5, "width", 0.57, 1.0, 8)]
RULES += [(k, "surface", 0.0, 1.0, 1) for k in (0, 3, 5)] + [(k, "surface", lo, hi, v) for k in (1, 2, 4) for lo, hi, v in ((0.0, 0.57, 1), (0.57, 1.0, 2))]


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    # numbered and measured once; all that follows reads them, and a line's last vertex is known from the same sort
    numbered = near_lines(spark, d).withColumn("last", F.max("seq").over(Window.partitionBy("id")))
    at = written(X.fractions(numbered.select("id", "seq", "x", "y", "last")))
    vertices = at.drop("last")
    tied = at.where("seq = 1 OR seq = last OR seq % 3 = 0").where("at IS NOT NULL")
    name = F.col("id").cast("bigint") * 10 + F.col("seq")
    refs = tied.select("id", name.alias("connector"), "at")
    # one connector in 400 is missing, one in 300 lies beside the line
    shift = F.when(name % 300 == 0, 7).otherwise(0)
    connectors = tied.where(name % 400 != 7).select(name.alias("connector"), (F.col("x") + shift).alias("x"), (F.col("y") - shift).alias("y"))
    rule = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("layer"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(v).cast("bigint").alias("value")) for k, n, lo, hi, v in RULES])
    rules = at.where("seq = 1").select("id", F.explode(rule).alias("r")).where("id % 7 = r.k").select("id", "r.layer", "r.lo", "r.hi", "r.value")
    return vertices, refs, connectors, rules


def _graph(spark: SparkSession, d: str):
    return X.transport_graph(*_inputs(spark, d), ["width", "surface"], 0.001)


_BASE = f"""WITH {WAY_NODES}, near AS (SELECT id, seq, id % 1000 * 250 + ref * 131 % 500 AS x, id // 1000 * 250 + ref * 977 % 500 AS y FROM way_nodes),
s AS (SELECT *, coalesce(sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)), 0) AS len, max(seq) OVER (PARTITION BY id) AS last FROM near WINDOW w AS (PARTITION BY id ORDER BY seq)),
v AS (SELECT id, seq, x, y, last, CASE WHEN sum(len) OVER (PARTITION BY id) > 0 THEN CASE WHEN seq = last THEN 1.0::DOUBLE ELSE sum(len) OVER (PARTITION BY id ORDER BY seq) / sum(len) OVER (PARTITION BY id) END END AS pos FROM s),
c AS (SELECT id, id * 10 + seq AS connector, pos, x, y FROM v WHERE (seq = 1 OR seq = last OR seq % 3 = 0) AND pos IS NOT NULL),
u AS (SELECT i.id, r.* FROM (SELECT DISTINCT id FROM way_nodes) i JOIN (VALUES {', '.join(map(str, RULES))}) r(k, layer, lo, hi, value) ON i.id % 7 = k),
faults AS (SELECT DISTINCT id, fault FROM (SELECT id, 'short' AS fault FROM v WHERE pos IS NULL UNION ALL SELECT id, unnest(['short', 'ends']) FROM v GROUP BY id HAVING max(pos) IS NULL
 UNION ALL SELECT id, 'ambiguous' FROM c GROUP BY id HAVING count(*) <> count(DISTINCT pos)
 UNION ALL SELECT id, 'unknown' FROM c WHERE connector % 400 = 7 UNION ALL SELECT id, CASE WHEN n > 1 THEN 'repeated' ELSE 'off the line' END FROM (SELECT *, count(*) OVER (PARTITION BY connector) AS n FROM c WHERE connector % 400 <> 7) WHERE n > 1 OR connector % 300 = 0
 UNION ALL SELECT id, 'width gap' FROM v WHERE id % 7 = 3 UNION ALL SELECT id, 'width overlap' FROM v WHERE id % 7 = 5)),
good AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM faults)),
b AS (SELECT DISTINCT id, pos FROM good UNION SELECT id, lo FROM u WHERE id IN (SELECT id FROM good)),
p AS (SELECT id, pos AS lo, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS hi FROM b),
e AS (SELECT id, pos AS lo, x, y, lead(pos) OVER w AS hi, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (SELECT id, pos, max(x) AS x, max(y) AS y FROM good GROUP BY id, pos) WINDOW w AS (PARTITION BY id ORDER BY pos)),
pieces AS (SELECT p.id, (SELECT count(*) FROM c WHERE c.id = p.id AND c.pos <= p.lo) - 1 AS road, p.lo, p.hi, e.x + (p.lo - e.lo) / (e.hi - e.lo) * (e.x2 - e.x) AS x, e.y + (p.lo - e.lo) / (e.hi - e.lo) * (e.y2 - e.y) AS y, e.x + (p.hi - e.lo) / (e.hi - e.lo) * (e.x2 - e.x) AS x2, e.y + (p.hi - e.lo) / (e.hi - e.lo) * (e.y2 - e.y) AS y2, w.value AS width, f.value AS surface
 FROM p JOIN e ON e.id = p.id AND e.lo <= p.lo AND p.lo < e.hi LEFT JOIN u w ON w.id = p.id AND w.layer = 'width' AND w.lo <= p.lo AND p.lo < w.hi LEFT JOIN u f ON f.id = p.id AND f.layer = 'surface' AND f.lo <= p.lo AND p.lo < f.hi WHERE p.hi IS NOT NULL)"""
_ROUNDED = ("lo", "hi", "x", "y", "x2", "y2")


@query("pip08_graph_pieces", f"{_BASE} SELECT id, road, row_number() OVER (PARTITION BY id, road ORDER BY lo) AS n, {', '.join(f'round({c}, 4) AS {c}' for c in _ROUNDED)}, CAST(width AS BIGINT) AS width, CAST(surface AS BIGINT) AS surface FROM pieces")
def _(spark, d):
    return _graph(spark, d)[0].withColumns({c: F.round(c, 4) for c in _ROUNDED})


@query("pip08_graph_roads", f"{_BASE}, k AS (SELECT id, connector, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS road, lead(connector) OVER (PARTITION BY id ORDER BY pos) AS other FROM c WHERE id IN (SELECT id FROM good)) SELECT k.id, k.road, connector AS start, other AS \"end\", (SELECT count(*) FROM pieces q WHERE q.id = k.id AND q.road = k.road) AS pieces FROM k WHERE other IS NOT NULL")
def _(spark, d):
    return _graph(spark, d)[1]


@query("pip08_graph_faults", f"{_BASE} SELECT * FROM faults")
def _(spark, d):
    return _graph(spark, d)[2]
