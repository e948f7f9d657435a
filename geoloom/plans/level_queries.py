"""Levels of touching water: a unit for every customer, touching those before and after it and in the next row."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import levels as L
from geoloom.plans.base import query, table

# The serial run: one step an edge, the state of all groups in lists. Pairs that are out of range by themselves stay so and need no step.
SERIAL = """
WITH RECURSIVE u AS (SELECT CAST(c_custkey AS BIGINT) AS id, row_number() OVER (ORDER BY c_custkey) AS i, CAST(c_custkey AS BIGINT) * 7919 % 400 AS low, CAST(c_custkey AS BIGINT) % 30 AS m, CAST(c_custkey AS BIGINT) % 40 AS h, c_custkey % 4 = 0 AS tight FROM customer),
p AS (SELECT a.i AS a, b.i AS b, a.tight OR b.tight AS narrow, abs(a.low - b.low) AS d FROM u a JOIN u b ON b.id IN (a.id + 1, a.id + 13)
 WHERE greatest(CASE WHEN NOT a.tight THEN a.low + a.m END, CASE WHEN NOT b.tight THEN b.low + b.m END, -1000000) - least(a.low, b.low) <= 60 AND greatest(CASE WHEN a.tight THEN a.low + a.m + a.h END, CASE WHEN b.tight THEN b.low + b.m + b.h END, -1000000) - least(a.low, b.low) <= 110),
e AS (SELECT row_number() OVER (ORDER BY narrow, d, a, b) AS n, a, b FROM p),
r(k, n, g, lo, mid, hi) USING KEY (k) AS (
 SELECT 1, CAST(0 AS BIGINT), list(i ORDER BY i), list(low ORDER BY i), list(CASE WHEN tight THEN -1000000 ELSE low + m END ORDER BY i), list(CASE WHEN tight THEN low + m + h ELSE -1000000 END ORDER BY i) FROM u
 UNION
 SELECT 1, n + 1, CASE WHEN ok THEN list_transform(g, lambda x: CASE WHEN x = lose THEN keep ELSE x END) ELSE g END, CASE WHEN ok THEN list_transform(lo, lambda x, i: CASE WHEN i = keep THEN l ELSE x END) ELSE lo END,
  CASE WHEN ok THEN list_transform(mid, lambda x, i: CASE WHEN i = keep THEN m ELSE x END) ELSE mid END, CASE WHEN ok THEN list_transform(hi, lambda x, i: CASE WHEN i = keep THEN h ELSE x END) ELSE hi END
 FROM (SELECT *, keep <> lose AND m - l <= 60 AND h - l <= 110 AS ok FROM (SELECT *, least(lo[keep], lo[lose]) AS l, greatest(mid[keep], mid[lose]) AS m, greatest(hi[keep], hi[lose]) AS h FROM (SELECT r.*, least(g[a], g[b]) AS keep, greatest(g[a], g[b]) AS lose FROM r JOIN e ON e.n = r.n + 1))))
SELECT u.id, (SELECT w.id FROM u w WHERE w.i = r.g[u.i]) AS grp, r.lo[r.g[u.i]] AS level FROM u, r
"""


@query("gra16_levels", SERIAL)
def _(spark, d):
    k = F.col("c_custkey").cast("bigint")
    low = k * 7919 % 400
    units = table(spark, d, "customer").select(k.alias("id"), low.alias("low"), (low + k % 30).alias("median"), (low + k % 30 + k % 40).alias("high"), (k % 4 == 0).alias("tight"))
    edges = units.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 13)).alias("b"))
    return L.join_levels(units, edges, 60, 110)[0]
