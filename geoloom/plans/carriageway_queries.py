"""Opposite carriageways: a ladder of one of seven shapes at every customer, and tangles of rungs from the vertices of ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import carriageways as C
from geoloom.operators.spatial import grown
from geoloom.plans.base import WAY_NODES, query, table, way_nodes

#: Nodes of a ladder: the first carriageway runs east over 0 to 3, the second west over 4 to 7. Fixed values of the fixture.
PLACES = {0: (0, 0), 1: (100, 0), 2: (200, 0), 3: (300, 0), 4: (300, 12), 5: (200, 12), 6: (100, 12), 7: (0, 12), 8: (100, 60), 9: (0, 100), 10: (110, 6), 11: (190, 6), 12: (190, 90)}
SIDES = [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 4, 5), (4, 5, 6), (5, 6, 7)]
TIES = [(6, 1, 6), (7, 2, 5)]
#: Pieces (piece, from, to) of each shape; those before 6 are one-way.
SHAPES = {
    0: SIDES + TIES,  # whole
    1: SIDES,  # no rung
    2: SIDES,  # no rung, but a motorway
    3: SIDES + TIES,  # a building in the second cell
    4: [*SIDES, *TIES, (8, 10, 11), (9, 11, 12)],  # a road that comes in from outside
    5: SIDES + TIES,  # a structure at the end
    6: [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 4, 5), (4, 5, 8), (5, 8, 9), (7, 2, 5)],  # sides that part
    7: [*SIDES, *TIES, (8, 10, 11), (9, 1, 10)],  # a median link that leads nowhere else
}
KINDS = "CASE k % 8 WHEN 2 THEN 'motorway' ELSE 'primary' END"


def _base(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    return table(spark, d, "customer").select(k.alias("k"), (k % 100 * 2000).alias("x"), (F.floor(k / 100) * 500).alias("y"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """(id, piece, a, b, kind, seq, x, y, x2, y2)"""
    names = ("piece", "a", "b", "x", "y", "x2", "y2")
    piece = lambda p: F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, (*p, *PLACES[p[1]], *PLACES[p[2]]), strict=True)])
    shape = F.coalesce(*[F.when(F.col("k") % 8 == s, F.array(*map(piece, ps))) for s, ps in SHAPES.items()])
    each = _base(spark, d).select("k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(shape).alias("p"))
    each = grown(each)
    at = [(F.col(f"p.{c}") + F.col(f"{c[0]}0")).alias(c) for c in ("x", "y", "x2", "y2")]
    return each.select((F.col("k") * 20 + F.col("p.piece")).alias("id"), "p.piece", (F.col("k") * 20 + F.col("p.a")).alias("a"), (F.col("k") * 20 + F.col("p.b")).alias("b"), F.expr(KINDS).alias("kind"), F.lit(0).cast("bigint").alias("seq"), *at)


def ladders(spark: SparkSession, d: str) -> tuple:
    """The arguments of ``merge_carriageways``."""
    each = _pieces(spark, d)
    line = ["id", "seq", "x", "y", "x2", "y2"]
    size = F.sqrt(((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y"))).cast("double"))
    oneway = each.where("piece < 6")
    corner = F.array(*[F.struct(F.lit(n).cast("bigint").alias("seq"), (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), (F.col("x") + x2).alias("x2"), (F.col("y") + y2).alias("y2")) for n, (x, y, x2, y2) in enumerate([(130, 4, 170, 4), (170, 4, 170, 8), (170, 8, 130, 8), (130, 8, 130, 4)])])
    houses = _base(spark, d).where("k % 8 = 3").select(F.col("k").alias("id"), F.explode(corner).alias("e")).select("id", "e.*")
    anchors = _base(spark, d).where("k % 8 = 5").select((F.col("x") + 306).alias("x"), (F.col("y") + 6).alias("y"))
    return (oneway.select("id", "a", "b", "kind"), oneway.select(line), each.select("id", "a", "b", size.alias("length")), each.select(line), houses, anchors, ["motorway", "trunk"])


_CELLS = "SELECT CAST(c_custkey AS BIGINT) * 20 AS a, CAST(c_custkey AS BIGINT) * 20 + 3 AS b, n, k0, 3 - k0 AS j0, k0 + 1 AS k1, 2 - k0 AS j1, 100.0::DOUBLE AS length, reason FROM customer JOIN (SELECT m, n, n - 1 AS k0, CAST(CASE WHEN m = 3 AND n = 2 THEN 'obstacle' WHEN m = 4 AND n = 2 THEN 'road' WHEN m = 5 AND n = 3 THEN 'structure' END AS VARCHAR) AS reason FROM range(8) r(m), range(1, 4) q(n) WHERE m <> 6 UNION ALL SELECT 6, 1, 2, NULL) v ON c_custkey % 8 = m"
_ROLES = {0: ([0, 1, 2], [3, 4, 5], [6, 7], [], 1), 2: ([0, 1, 2], [3, 4, 5], [], [], 1), 6: ([2], [3], [7], [], 1), 7: ([0, 1, 2], [3, 4, 5], [6, 7], [8, 9], 1), 5: ([0, 1], [4, 5], [6, 7], [], 1)}
_MERGED = [(m, i, role, run) for m, (*parts, run) in _ROLES.items() for role, ids in zip(("a", "b", "rung", "link"), parts, strict=True) for i in ids]
_MERGED += [(m, i, role, run) for m in (3, 4) for i, role, run in ((0, "a", 1), (5, "b", 1), (6, "rung", 1), (2, "a", 3), (3, "b", 3), (7, "rung", 3))]


@query("gra17_ladder_cells", _CELLS)
def _(spark, d):
    return C.carriageway_cells(*ladders(spark, d)).withColumn("length", F.round("length", 6))


@query("gra17_merged_roads", f"SELECT CAST(c_custkey AS BIGINT) * 20 + i AS id, role, CAST(c_custkey AS BIGINT) * 20 AS a, CAST(c_custkey AS BIGINT) * 20 + 3 AS b, CAST(run AS BIGINT) AS run FROM customer JOIN (VALUES {', '.join(map(str, _MERGED))}) v(m, i, role, run) ON c_custkey % 8 = m")
def _(spark, d):
    return C.merge_carriageways(*ladders(spark, d))[1]


# The serial program: a step a rung, with the weights and predecessors so far in lists.
_SERIAL = f"""WITH RECURSIVE {WAY_NODES},
g AS (SELECT id // 16 AS pair, row_number() OVER (PARTITION BY id // 16 ORDER BY id, seq) AS k, ref FROM way_nodes),
q AS (SELECT pair, k, 500 - k + ref * 31 % 9 AS j, 1 + CAST(ref % 3 = 0 AS INT) AS w FROM g),
r(pair, n, js, ws, score, before) USING KEY (pair) AS (
 SELECT pair, CAST(0 AS BIGINT), list(j ORDER BY k), list(w ORDER BY k), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM q GROUP BY pair
 UNION
 SELECT pair, n + 1, js, ws, list_append(score, best + ws[n + 1]), list_append(before, CASE WHEN best > 0 THEN list_position(able, best) ELSE 0 END)
 FROM (SELECT *, coalesce(list_max(able), 0) AS best FROM (SELECT *, list_transform(score, lambda s, i: CASE WHEN js[i] > js[n + 1] THEN s ELSE 0 END) AS able FROM r WHERE n < len(js)))),
t AS (SELECT pair, list_position(score, list_max(score)) AS k, before, js FROM r UNION ALL SELECT pair, before[k], before, js FROM t WHERE before[k] > 0)
SELECT pair AS a, CAST(k AS BIGINT) AS k, js[k] AS j FROM t"""


@query("gra17_aligned_rungs", _SERIAL)
def _(spark, d):
    from pyspark.sql import Window

    pair = F.floor(F.col("id") / 16)
    k = F.row_number().over(Window.partitionBy(pair).orderBy("id", "seq")).cast("bigint")
    found = way_nodes(spark, d).select(F.struct(pair.alias("a"), F.lit(0).alias("b")).alias("pair"), k.alias("k"), "ref")
    found = found.select("pair", "k", (500 - F.col("k") + F.col("ref") * 31 % 9).alias("j"), (1 + (F.col("ref") % 3 == 0).cast("int")).alias("weight"))
    return C.align(found).select("pair.a", "k", "j")
