"""Structures at every customer, in one of eight shapes: what becomes of their chains, and the heights of what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import structures as T
from geoloom.operators.spatial import grown
from geoloom.plans.base import query, table

#: Ways of each shape: (way, nodes, layer, bridge); nodes are (number, x, y). Structures are those off layer 0. Fixed values of the fixture.
_EAST = [(0, (0, 0, 0), (1, 400, 0), 0, False), (1, (1, 400, 0), (2, 600, 0), 1, True), (2, (2, 600, 0), (3, 1000, 0), 0, False)]
_STREET = (3, (4, 500, -200), (5, 500, 200), 0, False)
SHAPES = {
    0: [*_EAST, _STREET],  # long enough by itself
    1: [(0, (0, 0, 0), (1, 460, 0), 0, False), (1, (1, 460, 0), (2, 540, 0), 1, True), (2, (2, 540, 0), (3, 1000, 0), 0, False), _STREET],  # with ramps
    2: [(0, (0, 0, 0), (1, 460, 0), 0, False), (1, (1, 460, 0), (2, 540, 0), 1, True), (2, (2, 540, 0), (3, 1000, 0), 0, False), _STREET, (4, (1, 460, 0), (6, 460, 90), 0, False), (5, (2, 540, 0), (7, 540, 90), 0, False)],  # junctions at both ends
    3: [_EAST[0], (1, (1, 400, 0), (2, 600, 0), -1, False), _EAST[2], _STREET],  # a tunnel
    4: [_EAST[0], (1, (1, 400, 0), (2, 600, 0), -1, False), _EAST[2]],  # a tunnel under nothing
    5: [*_EAST, (3, (4, 500, -200), (5, 500, 200), 1, True)],  # two bridges of one layer
    6: [*_EAST, (3, (4, 500, -200), (5, 500, 200), 2, True)],  # a bridge over a bridge
    7: [_EAST[0], (1, (1, 400, 0), (2, 500, 0), 1, True), (2, (2, 500, 0), (3, 600, 0), 1, True), (5, (3, 600, 0), (6, 1000, 0), 0, False), (3, (4, 480, -200), (5, 480, 200), 0, False)],  # a chain of two
}
SCHEMA = "way bigint, na bigint, xa bigint, ya bigint, nb bigint, xb bigint, yb bigint, layer bigint, bridge boolean"


def _town(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = [c.split() for c in SCHEMA.split(", ")]
    way = lambda w: F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip((w[0], *w[1], *w[2], w[3], w[4]), names, strict=True)])
    k = F.col("c_custkey").cast("bigint")
    shape = F.coalesce(*[F.when(k % 8 == s, F.array(*map(way, ws))) for s, ws in SHAPES.items()])
    each = table(spark, d, "customer").select(k.alias("k"), F.explode(shape).alias("w")).select("k", "w.*")
    each = grown(each)
    node = lambda c: F.col("k") * 10 + F.col(c)
    off = F.col("layer") != 0
    ways = each.select(node("way").alias("id"), node("na").alias("a"), node("nb").alias("b"), "layer", off.alias("structure"), "bridge", off.alias("candidate"), F.lit(False).alias("level"), F.lit(False).alias("walking"))
    x0, y0 = F.col("k") % 100 * 2000, F.floor(F.col("k") / 100) * 600
    ends = F.array(*[F.struct(F.lit(i).cast("bigint").alias("seq"), node(f"n{e}").alias("ref"), (F.col(f"x{e}") + x0).alias("x"), (F.col(f"y{e}") + y0).alias("y")) for i, e in ((1, "a"), (2, "b"))])
    return ways, each.select(node("way").alias("id"), F.explode(ends).alias("v")).select("id", "v.*")


_STATUS = {0: {1: "estimated"}, 1: {1: "estimated"}, 2: {1: "separation"}, 3: {1: "estimated"}, 4: {1: "level"}, 5: {1: "separation", 3: "estimated"}, 6: {1: "estimated", 3: "estimated"}, 7: {1: "estimated"}}
_ROWS = ", ".join(str((m, w, s)) for m, ws in _STATUS.items() for w, s in ws.items())


@query("gra11_structure_status", f"SELECT CAST(c_custkey AS BIGINT) * 10 + w AS chain, status FROM customer JOIN (VALUES {_ROWS}) v(m, w, status) ON c_custkey % 8 = m")
def _(spark, d):
    return T.estimate_structures(*_town(spark, d), 500)[0]


# Kept ways: (shape, way, length before it, its length, the chain's length, layer, first x, first y, step x, step y, nodes).
_KEPT = [(0, 1, 0, 200, 200, 1, 400, 0, 1, 0, 1, 2), (1, 0, 0, 460, 1000, 1, 0, 0, 1, 0, 0, 1), (1, 1, 460, 80, 1000, 1, 460, 0, 1, 0, 1, 2), (1, 2, 540, 460, 1000, 1, 540, 0, 1, 0, 2, 3), (3, 1, 0, 200, 200, -1, 400, 0, 1, 0, 1, 2), (5, 3, 0, 400, 400, 1, 500, -200, 0, 1, 4, 5), (6, 1, 0, 200, 200, 1, 400, 0, 1, 0, 1, 2), (6, 3, 0, 400, 400, 2, 500, -200, 0, 1, 4, 5), (7, 0, 0, 400, 600, 1, 0, 0, 1, 0, 0, 1), (7, 1, 400, 100, 600, 1, 400, 0, 1, 0, 1, 2), (7, 2, 500, 100, 600, 1, 500, 0, 1, 0, 2, 3)]
_HEIGHTS = f"""WITH w AS (SELECT CAST(c_custkey AS BIGINT) AS k, v.* FROM customer JOIN (VALUES {', '.join(map(str, _KEPT))}) v(m, w, o, s, t, l, x, y, dx, dy, na, nb) ON c_custkey % 8 = m),
h AS (SELECT *, 8 + least(6.0 * abs(l), 0.08 * (t / 2.0 - 8)) / 0.08 AS top FROM w),
d AS (SELECT *, 0 AS r, CAST(o AS DOUBLE) AS pos FROM h UNION ALL SELECT *, 1, CAST(o + s AS DOUBLE) FROM h
 UNION ALL SELECT * FROM (SELECT *, 2, CAST(unnest(CASE WHEN t - 2 * top >= 1 THEN [8, top, t - top, t - 8] ELSE [8, t / 2.0, t - 8] END) AS DOUBLE) AS pos FROM h) WHERE pos > o + 0.5 AND pos < o + s - 0.5)
SELECT k * 10 + w AS id, round(pos - o, 6) AS "at", CAST(x + k % 100 * 2000 + (pos - o) * dx AS DOUBLE) AS x, CAST(y + k // 100 * 600 + (pos - o) * dy AS DOUBLE) AS y,
 CASE WHEN least(pos - 8, t - pos - 8) <= 0 THEN CAST(0 AS DOUBLE) ELSE round(sign(l) * least(6.0 * abs(l), 0.08 * least(pos - 8, t - pos - 8)), 6) END AS height, CASE r WHEN 0 THEN k * 10 + na WHEN 1 THEN k * 10 + nb END AS ref FROM d"""


@query("gra11_structure_heights", _HEIGHTS)
def _(spark, d):
    ways, vertices = _town(spark, d)
    found = T.structure_points(T.estimate_structures(ways, vertices, 500)[1], vertices)
    return found.select("id", F.round("at", 6).alias("at"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("height").cast("double").alias("height"), "ref")


_CHAINS = {0: [1], 1: [1], 2: [1], 3: [1], 4: [1], 5: [1, 3], 6: [1, 3], 7: [1, 1]}
_LINKS = ", ".join(str((m, c, r, c + r)) for m, cs in _CHAINS.items() for i, c in enumerate(cs) for r in [sum(c == b for b in cs[:i])])


@query("gra04_structure_chains", f'SELECT CAST(c_custkey AS BIGINT) * 10 + c AS chain, CAST(r AS BIGINT) AS "rank", CAST(c_custkey AS BIGINT) * 10 + w AS way, false AS backward FROM customer JOIN (VALUES {_LINKS}) v(m, c, r, w) ON c_custkey % 8 = m')
def _(spark, d):
    ways, vertices = _town(spark, d)
    return T.structure_chains(ways, T._joins(ways, T._arms(ways, vertices)[0]))
