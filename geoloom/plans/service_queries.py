"""Service paint over a small network at every customer, of one of seven shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import service as V
from geoloom.plans.base import query, table

#: Pieces of each shape: (piece, from, to, metres, highway, service). Nodes are numbers within the network, -1 an end cut off. Fixed values of the fixture.
SHAPES = {
    0: [(0, 0, 1, 90, "residential", None), (3, 1, 4, 30, "residential", None), (1, 1, 2, 10, "service", None)],  # a stub at a junction
    1: [(0, 0, 1, 90, "residential", None), (3, 1, 4, 30, "residential", None), (1, 1, 2, 6, "service", None), (2, 2, 3, 6, "service", None)],  # a stub of two pieces
    2: [(0, 0, 1, 90, "residential", None), (3, 1, 4, 30, "residential", None), (1, 1, 2, 9, "service", None), (2, 2, 3, 9, "service", None)],  # as long as 18 m: none
    3: [(0, 0, 1, 90, "residential", None), (1, 1, 2, 40, "service", "driveway"), (2, 2, 3, 80, "residential", None)],  # a driveway that alone connects
    4: [(0, 0, 1, 90, "residential", None), (3, 1, 4, 30, "residential", None), (1, 1, 2, 60, "service", "parking_aisle"), (2, 2, -1, 60, "service", "parking_aisle")],  # aisles that lead nowhere
    5: [(0, 0, 1, 90, "residential", None), (1, 1, 2, 50, "track", None), (2, 2, 0, 50, "track", None)],  # tracks back to the same road
    6: [(0, 0, 1, 90, "residential", None), (1, 1, 2, 50, "track", None), (2, 2, 3, 50, "service", "driveway"), (3, 3, 4, 70, "residential", None), (4, 2, 5, 12, "service", "driveway")],  # a link of two kinds with a twig
}


def roads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    piece = lambda p: F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(p, ("bigint", "bigint", "bigint", "double", "string", "string"), ("piece", "u", "v", "length", "highway", "service"), strict=True)])
    shape = F.coalesce(*[F.when(k % 7 == s, F.array(*map(piece, ps))) for s, ps in SHAPES.items()])
    each = table(spark, d, "customer").select(k.alias("k"), F.explode(shape).alias("p")).select("k", "p.*")
    node = lambda c: F.when(F.col(c) >= 0, F.col("k") * 10 + F.col(c))
    flags = [F.lit(True).alias("driving"), F.lit(False).alias("fixed"), F.lit(False).alias("structural"), F.when(F.col("k") % 2 == 0, "gravel").alias("surface")]
    return each.select((F.col("k") * 10 + F.col("piece")).alias("road"), node("u").alias("a"), node("v").alias("b"), "length", "highway", "service", *flags)


@query("gra12_service_paint", "SELECT CAST(c_custkey AS BIGINT) * 10 + piece AS road, kind, CASE WHEN c_custkey % 2 = 0 THEN 'gravel' WHEN kind = 'track' THEN 'dirt' ELSE 'asphalt' END AS surface FROM customer JOIN (VALUES (0, 1, 'service'), (1, 1, 'service'), (1, 2, 'service'), (4, 1, 'service'), (4, 2, 'service'), (5, 1, 'track'), (5, 2, 'track'), (6, 4, 'service')) p(m, piece, kind) ON c_custkey % 7 = m")
def _(spark, d):
    return V.paint_service(roads(spark, d))


@query("gra12_stub_paths", "SELECT CAST(c_custkey AS BIGINT) * 10 + piece AS road FROM customer JOIN (VALUES (0, 1), (1, 1), (1, 2), (6, 4)) p(m, piece) ON c_custkey % 7 = m")
def _(spark, d):
    return V.stub_paths(roads(spark, d))
