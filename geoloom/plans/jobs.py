"""Composite jobs: vertical conversion, annotation with evidence, and the quality report of a road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import aggregates as A
from geoloom.operators import changes as C
from geoloom.operators import fusion as U
from geoloom.operators import graph as GR
from geoloom.operators import spatial as P
from geoloom.operators import terrain as TE
from geoloom.plans.base import query, table
from geoloom.plans.fused import OVER, plots, sites
from geoloom.plans.space import _BOTH, _LABELS, RASTER, _graph, _raster, _span


def convert_heights(points: DataFrame, grid: DataFrame, west: float, south: float, step: float) -> tuple[DataFrame, DataFrame]:
    """Points (id, x, y, h) with h corrected by a grid of deltas, and the points that the grid doesn't cover, which refuse."""
    delta = P.bilinear(points, grid, west, south, step).select(F.col("id").alias("_id"), F.col("h").alias("_delta"))
    both = points.join(delta, F.col("id") == F.col("_id"), "left").drop("_id")
    return both.where("_delta IS NOT NULL").withColumn("h", F.col("h") + F.col("_delta")).drop("_delta"), both.where("_delta IS NULL").drop("_delta")


def annotate(buildings: DataFrame, auxiliary: DataFrame, cell: int, least: float, context: float) -> DataFrame:
    """(id, height, height_basis): own height, else that of the best matching auxiliary footprint, else the context's."""
    match = U.best_match(buildings.drop("h"), auxiliary.drop("h"), cell, least)
    aux = match.join(auxiliary.select(F.col("id").alias("_aux"), F.col("h").alias("_ah")), F.col("b_id") == F.col("_aux")).select("a_id", "_ah")
    both = buildings.join(aux, F.col("id") == F.col("a_id"), "left")
    return both.select("id", *C.resolve("height", ("source", F.col("h")), ("auxiliary", F.col("_ah")), ("context", F.lit(context))))


def quality_report(edges: DataFrame) -> DataFrame:
    """One row on a graph's shape."""
    return A.topology(edges, GR.components(edges))


@query("pip05_vertical", "WITH g AS (SELECT vec_id AS row, unnest(range(0, 64)) AS col, unnest(embedding) AS d FROM embeddings), p AS (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 37 % 700) / 10.0 AS x, (c_custkey * 53 % (SELECT max(vec_id) * 10 FROM embeddings)) / 10.0 AS y, c_acctbal AS h FROM customer), k AS (SELECT *, floor(x) AS c, floor(y) AS r, x - floor(x) AS u, y - floor(y) AS v FROM p WHERE x <= 63) SELECT k.id, round(k.h + a.d * (1 - u) * (1 - v) + coalesce(b.d, 0) * u * (1 - v) + e.d * (1 - u) * v + coalesce(f.d, 0) * u * v, 4) AS h FROM k JOIN g a ON a.row = r AND a.col = c LEFT JOIN g b ON b.row = r AND b.col = c + 1 JOIN g e ON e.row = r + 1 AND e.col = c LEFT JOIN g f ON f.row = r + 1 AND f.col = c + 1")
def _(spark, d):
    k = F.col("c_custkey").cast("bigint")
    pts = table(spark, d, "customer").select(k.alias("id"), (k * 37 % 700 / 10.0).alias("x"), (k * 53 % _span(spark, d) / 10.0).alias("y"), F.col("c_acctbal").alias("h"))
    return convert_heights(pts, _raster(spark, d), 0.0, 0.0, 1.0)[0].select("id", F.round("h", 4).alias("h"))


@query("pip03_annotated", f"WITH {OVER}, m AS (SELECT a, CAST(min_by(b, -(c / (s + t - c)) * 1000000 + b / 1000000.0) AS BIGINT) AS b FROM o WHERE c / (s + t - c) >= 0.5 GROUP BY a), r AS (SELECT h.id, CASE WHEN h.id % 4 = 0 THEN CAST(h.id % 50 AS DOUBLE) END AS own, CASE WHEN m.b % 3 <> 0 THEN CAST(m.b % 30 AS DOUBLE) END AS aux FROM sites h LEFT JOIN m ON m.a = h.id) SELECT id, coalesce(own, aux, 6.0::DOUBLE) AS height, CASE WHEN own IS NOT NULL THEN 'source' WHEN aux IS NOT NULL THEN 'auxiliary' ELSE 'context' END AS height_basis FROM r")
def _(spark, d):
    k = F.col("id")
    own = sites(spark, d).withColumn("h", F.when(k % 4 == 0, (k % 50).cast("double")))
    aux = plots(spark, d).withColumn("h", F.when(k % 3 != 0, (k % 30).cast("double")))
    return annotate(own, aux, 500, 0.5, 6.0)


@query("pip14_quality_report", f"WITH RECURSIVE {_BOTH}, {_LABELS}, c AS (SELECT count(DISTINCT label) AS components FROM r), g AS (SELECT node, count(*) AS k FROM (SELECT unnest([a, b]) AS node FROM e) GROUP BY node) SELECT count(*) AS nodes, CAST(sum(k) / 2 AS BIGINT) AS edges, CAST(sum((k > 2)::INT) AS BIGINT) AS junctions, CAST(sum((k = 1)::INT) AS BIGINT) AS dead_ends, any_value(components) AS components, CAST(sum(k) / 2 AS BIGINT) - count(*) + any_value(components) AS cycle_rank FROM g, c")
def _(spark, d):
    return quality_report(_graph(spark, d))


# Samples at half steps of the raster: cells of 9 by 9 samples, four steps wide.
SAMPLES = f"""{RASTER}, k AS (SELECT DISTINCT vec_id // 4 AS cy FROM embeddings WHERE (vec_id // 4 + 1) * 4 <= (SELECT max(vec_id) FROM embeddings)), cells AS (SELECT cy, unnest(range(15)) AS cx FROM k),
p AS (SELECT DISTINCT cy * 8 + j AS r, cx * 8 + i AS c FROM (SELECT cx, cy, unnest(range(9)) AS j FROM cells), (SELECT unnest(range(9)) AS i)),
s AS (SELECT r, c, (1 - r % 2 / 2) * ((1 - c % 2 / 2) * g0.h + c % 2 / 2 * coalesce(g1.h, 0)) + r % 2 / 2 * ((1 - c % 2 / 2) * coalesce(g2.h, 0) + c % 2 / 2 * coalesce(g3.h, 0)) AS h FROM p JOIN g g0 ON g0.row = r // 2 AND g0.col = c // 2 LEFT JOIN g g1 ON g1.row = r // 2 AND g1.col = c // 2 + 1 LEFT JOIN g g2 ON g2.row = r // 2 + 1 AND g2.col = c // 2 LEFT JOIN g g3 ON g3.row = r // 2 + 1 AND g3.col = c // 2 + 1),
{", ".join(f"{b} AS (SELECT r, c, {f}(h) OVER (PARTITION BY {y} ORDER BY {x} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h FROM {a})" for a, b, f, x, y in (("s", "o1", "min", "c", "r"), ("o1", "o2", "min", "r", "c"), ("o2", "o3", "max", "c", "r"), ("o3", "o4", "max", "r", "c")))},
{", ".join(f"{b} AS (SELECT r, c, 0.25 * coalesce(lag(h) OVER w, h) + 0.5 * h + 0.25 * coalesce(lead(h) OVER w, h) AS h FROM {a} WINDOW w AS (PARTITION BY {y} ORDER BY {x}))" for a, b, x, y in (("o4", "b1", "c", "r"), ("b1", "b2", "r", "c")))},
m AS (SELECT r, c, CAST(round_even((h + 1) * 100 / 0.01, 0) AS BIGINT) AS cm FROM b2), e AS (SELECT min(cm) AS low, greatest(1, CAST(ceil((max(cm) - min(cm)) / 65535.0) AS BIGINT)) AS step, count(*) AS n FROM m)"""


def _terrain(spark, d):
    rows = table(spark, d, "embeddings")
    cy = F.floor(F.col("vec_id") / 4)
    last = rows.agg(F.max("vec_id")).first()[0]
    cells = rows.where((cy + 1) * 4 <= last).select(cy.alias("cy")).distinct().withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(14)).cast("array<bigint>")))
    return TE.terrain(_raster(spark, d), cells, 9, 0.5, 1, [0.25, 0.5, 0.25], F.lit(-1.0), 0.01, tile=64)


@query("pip06_terrain", f"WITH {SAMPLES} SELECT cx, cy, r - cy * 8 AS j, c - cx * 8 AS i, cm, CAST(round_even((cm - low) / step, 0) AS BIGINT) AS q FROM m, e, cells WHERE r BETWEEN cy * 8 AND cy * 8 + 8 AND c BETWEEN cx * 8 AND cx * 8 + 8")
def _(spark, d):
    return _terrain(spark, d)[0]


@query("pip06_terrain_summary", f"WITH {SAMPLES} SELECT low AS \"offset\", step, 0.5 + step / 2 AS max_error, CAST(NULL AS VARCHAR) AS fault FROM e")
def _(spark, d):
    return _terrain(spark, d)[1]
