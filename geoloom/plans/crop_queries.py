"""Polygons cut at windows: an octagon with a square hole for every supplier, and a window that moves over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.cropping import crop_polygons
from geoloom.plans.base import query, table
from geoloom.plans.polygon_queries import INNER, OUTER


def _rings(spark: SparkSession, d: str) -> DataFrame:
    """Edges, holes drawn either way, with their polygon's own window."""
    k = F.col("s_suppkey").cast("bigint")
    own = table(spark, d, "supplier").select(k.alias("id"))
    edges = []
    for ring, (role, corners) in enumerate((("outer", OUTER), ("inner", INNER))):
        for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True)):
            edges.append(F.struct(F.lit(ring).alias("ring"), F.lit(role).alias("role"), F.lit(i).alias("seq"), F.lit(len(corners)).alias("n"), *[F.lit(v).alias(c) for v, c in zip((*a, *b), ("x", "y", "x2", "y2"), strict=True)]))
    all_ = own.select("id", F.explode(F.array(*edges)).alias("e")).select("id", "e.*")
    west, south = F.col("id") * 37 % 1200 - 1000, F.col("id") * 53 % 1100 - 900
    return all_.withColumns({"west": west, "south": south, "east": west + 120 + F.col("id") % 13 * 130, "north": south + 100 + F.col("id") % 11 * 150})


# The area of a polygon in a window by another way: along each edge, the integral over y of x held between west and east.
_EDGES = ", ".join(f"({role}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for role, corners in ((0, OUTER), (1, INNER)) for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
_PRIMITIVE = "CASE WHEN {u} < west THEN west * {u} WHEN {u} <= east THEN ({u} * {u} + west * west) / 2.0 ELSE east * {u} - (east * east - west * west) / 2.0 END"
_CROP = f"""WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier), w AS (SELECT id, id * 37 % 1200 - 1000 AS west, id * 53 % 1100 - 900 AS south FROM s),
b AS (SELECT *, west + 120 + id % 13 * 130 AS east, south + 100 + id % 11 * 150 AS north FROM w),
e AS (SELECT * FROM b CROSS JOIN (VALUES {_EDGES}) v(ring, x, y, x2, y2)),
c AS (SELECT *, greatest(least(y, y2), south) AS lo, least(greatest(y, y2), north) AS hi FROM e),
p AS (SELECT *, x + (lo - y) * CAST(x2 - x AS DOUBLE) / (y2 - y) AS xl, x + (hi - y) * CAST(x2 - x AS DOUBLE) / (y2 - y) AS xh FROM c WHERE lo < hi),
g AS (SELECT *, sign(y2 - y) * CASE WHEN xl = xh THEN least(greatest(xl, west), east) ELSE ({_PRIMITIVE.format(u='xh')} - ({_PRIMITIVE.format(u='xl')})) / (xh - xl) END * (hi - lo) AS part FROM p),
r AS (SELECT id, ring, abs(sum(part)) AS area FROM g GROUP BY id, ring), a AS (SELECT id, sum(CASE WHEN ring = 0 THEN area ELSE -area END) AS area FROM r GROUP BY id),
m AS (SELECT id, min(least(x, x2)) >= any_value(west) AND max(greatest(x, x2)) <= any_value(east) AND min(least(y, y2)) >= any_value(south) AND max(greatest(y, y2)) <= any_value(north) AS whole FROM e GROUP BY id)
SELECT id, CASE WHEN whole THEN 'whole' WHEN area > 1e-6 THEN 'cut' ELSE 'outside' END AS verdict, round(CASE WHEN area > 1e-6 THEN area ELSE 0 END, 2) AS area FROM m LEFT JOIN a USING (id)"""


@query("pip01_cropped_polygons", _CROP)
def _(spark, d):
    edges = _rings(spark, d)
    kept, verdicts = crop_polygons(edges, tuple(F.col(c) for c in ("west", "south", "east", "north")))
    pair = kept.groupBy("id", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))  # a dozen corners
    ahead = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    twice = F.aggregate(F.zip_with("p", ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    areas = pair.groupBy(F.col("id").alias("_id")).agg((F.sum(twice) / 2).alias("area"))
    both = verdicts.join(areas, F.col("id") == F.col("_id"), "left")
    verdict = F.when(F.col("verdict") == "contact", "outside").otherwise(F.col("verdict"))  # the SQL knows areas only
    return both.select("id", verdict.alias("verdict"), F.round(F.coalesce("area", F.lit(0.0)), 2).alias("area"))
