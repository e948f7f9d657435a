"""Roads over water at every customer, in one of six shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import water_crossings as W
from geoloom.plans.base import query, table

#: Ways of each shape: (way, from, to, metres of water, bridge, excluded); end nodes 0 and 9 are dry. Fixed values of the fixture.
SHAPES = {
    0: [(0, 0, 1, 0.0, False, False), (1, 1, 2, 30.0, False, False), (2, 2, 9, 0.0, False, False)],  # one wet way between dry ones
    1: [(0, 0, 1, 4.0, False, False), (1, 1, 2, 0.0, False, False), (2, 2, 9, 4.0, False, False)],  # an island
    2: [(0, 0, 1, 30.0, True, False), (1, 1, 9, 0.0, False, False)],  # a tagged bridge
    3: [(0, 0, 1, 0.0, False, False), (1, 1, 2, 30.0, False, True), (2, 2, 9, 0.0, False, False)],  # a ford
    4: [(0, 0, 1, 12.0, False, False), (1, 1, 2, 3.0, False, False), (2, 1, 9, 3.0, False, False)],  # a junction in the water
    5: [(0, 0, 1, 1.5, False, False), (1, 1, 9, 0.0, False, False)],  # the shore, touched
}
_WANT = [(0, 1, "inferred", 0), (1, 0, "inferred", 0), (1, 1, "inferred", 0), (1, 2, "inferred", 0), (2, 0, "explicit", None), (3, 1, "exception", None), (4, 0, "unresolved", None), (4, 1, "unresolved", None), (4, 2, "unresolved", None), (5, 0, "unresolved", None)]
_WATER = {(m, w[0]): w[3] for m, ws in SHAPES.items() for w in ws}
_ROWS = ", ".join(f"({m}, {w}, '{v}', {'NULL' if p is None else p}, {_WATER[m, w]})" for m, w, v, p in _WANT)


@query("gra09_water_crossings", f"SELECT CAST(c_custkey AS BIGINT) * 10 + w AS id, verdict, CAST(c_custkey AS BIGINT) * 10 + p AS path, CAST(wet AS DOUBLE) AS wet, verdict = 'unresolved' AS doubt FROM customer JOIN (VALUES {_ROWS}) v(m, w, verdict, p, wet) ON c_custkey % 6 = m")
def _(spark, d):
    names = list(zip(("way", "u", "v", "wet", "bridge", "excluded"), ("bigint", "bigint", "bigint", "double", "boolean", "boolean"), strict=True))
    way = lambda w: F.struct(*[F.lit(x).cast(t).alias(n) for x, (n, t) in zip(w, names, strict=True)])
    k = F.col("c_custkey").cast("bigint")
    each = table(spark, d, "customer").select(k.alias("k"), F.explode(F.coalesce(*[F.when(k % 6 == s, F.array(*map(way, ws))) for s, ws in SHAPES.items()])).alias("w")).select("k", "w.*")
    node = lambda c: F.col("k") * 10 + F.col(c)
    ways = each.select(node("way").alias("id"), node("u").alias("a"), node("v").alias("b"), "bridge", "excluded", "wet")
    vertices = ways.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.col(c).alias("ref")) for i, c in ((1, "a"), (2, "b"))])).alias("p")).select("id", "p.*")
    dry = table(spark, d, "customer").select(F.explode(F.array(k * 10, k * 10 + 9)).alias("node"))
    return W.water_crossings(ways.drop("wet"), vertices, ways.select("id", "wet"), dry)
