"""Fusion of auxiliary buildings, whole and for changed cells alone, and footprints against slanted roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import composition as K
from geoloom.plans.base import BOXES, HOMES, boxes, homes, query
from geoloom.plans.fused import OVER, plots, sites

# A piece of road at every home: slanted, some of them vertical, three pieces a road.
PIECES = "pieces AS (SELECT id // 3 AS road, id % 3 AS seq, x, y, x + CASE WHEN id % 10 = 0 THEN 0 ELSE 300 + id % 5 * 100 END AS x2, y + 400 - id % 7 * 150 AS y2, CAST(id % 11 AS DOUBLE) AS z, CAST(id % 13 AS DOUBLE) AS z2, 100 + id % 4 * 60 AS width, ['ground', 'bridge', 'tunnel'][CAST(id // 3 % 3 AS INT) + 1] AS kind FROM homes)"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    x2, y2 = F.col("x") + F.when(k % 10 == 0, 0).otherwise(300 + k % 5 * 100), F.col("y") + 400 - k % 7 * 150
    kind = F.when(F.floor(k / 3) % 3 == 0, "ground").when(F.floor(k / 3) % 3 == 1, "bridge").otherwise("tunnel")
    return homes(spark, d).select(F.floor(k / 3).alias("road"), (k % 3).alias("seq"), "x", "y", x2.alias("x2"), y2.alias("y2"), (k % 11).cast("double").alias("z"), (k % 13).cast("double").alias("z2"), (100 + k % 4 * 60).alias("width"), kind.alias("kind"))


def _hits(buildings: str) -> str:
    """CTEs that end in hits (id, road, seq): corners to the piece, ends to the box, and the piece clipped to the box."""
    def clip(low: str, high: str, a: str) -> str:
        flat = f"({a}2 = {a})"
        u, v = f"({low} - {a}) / nullif(CAST({a}2 - {a} AS DOUBLE), 0)", f"({high} - {a}) / nullif(CAST({a}2 - {a} AS DOUBLE), 0)"
        return f"CASE WHEN {flat} THEN CASE WHEN {a} BETWEEN {low} AND {high} THEN 0 ELSE 2 END ELSE least({u}, {v}) END", f"CASE WHEN {flat} THEN 1 ELSE greatest({u}, {v}) END"

    (bx0, bx1), (by0, by1) = clip("x0", "x1", "x"), clip("y0", "y1", "y")
    (wx0, wx1), (wy0, wy1) = clip("(x0 - width / 2)", "(x1 + width / 2)", "x"), clip("(y0 - width / 2)", "(y1 + width / 2)", "y")
    s = lambda p, q: f"greatest(0, least(1, (({p} - x) * (x2 - x) + ({q} - y) * (y2 - y)) / nullif(CAST((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS DOUBLE), 0)))"
    corners = ", ".join(f"pow({p} - x - (x2 - x) * {s(p, q)}, 2) + pow({q} - y - (y2 - y) * {s(p, q)}, 2)" for p in ("x0", "x1") for q in ("y0", "y1"))
    ends = ", ".join(f"pow(greatest(x0 - {p}, 0, {p} - x1), 2) + pow(greatest(y0 - {q}, 0, {q} - y1), 2)" for p, q in (("x", "y"), ("x2", "y2")))
    return f"""met AS (SELECT b.id, b.base, b.top, p.*, CASE WHEN greatest(0, {bx0}, {by0}) <= least(1, {bx1}, {by1}) THEN 0 ELSE least({corners}, {ends}) END AS d2, greatest(0, {wx0}, {wy0}) AS t0, least(1, {wx1}, {wy1}) AS t1
 FROM {buildings} b JOIN pieces p ON least(p.x, p.x2) - 200 <= b.x1 AND greatest(p.x, p.x2) + 200 >= b.x0 AND least(p.y, p.y2) - 200 <= b.y1 AND greatest(p.y, p.y2) + 200 >= b.y0),
near AS (SELECT *, CASE kind WHEN 'bridge' THEN least(z + (z2 - z) * t0, z + (z2 - z) * t1) >= top + 0.5 WHEN 'tunnel' THEN greatest(z + (z2 - z) * t0, z + (z2 - z) * t1) + 0.5 <= base ELSE false END AS clear FROM met WHERE d2 < width * width / 4),
hits AS (SELECT id, road, seq FROM near n WHERE EXISTS (SELECT 1 FROM near m WHERE m.id = n.id AND m.road = n.road AND NOT m.clear))"""


HOUSES = "houses AS (SELECT *, CAST(id % 3 * 4 AS DOUBLE) AS base, CAST(id % 3 * 4 + 3 + id % 9 AS DOUBLE) AS top FROM boxes)"


@query("jon35_road_conflicts", f"WITH {HOMES}, {BOXES}, {HOUSES}, {PIECES}, {_hits('houses')} SELECT id, road, seq FROM hits")
def _(spark, d):
    k = F.col("id")
    base = (k % 3 * 4).cast("double")
    return K.road_conflicts(boxes(spark, d).withColumns({"base": base, "top": base + 3 + k % 9}), pieces(spark, d), 1000)


def sources(spark: SparkSession, d: str) -> K.Sources:
    k = F.col("id")
    base = plots(spark, d).select(*K.BOX, F.when(k % 5 > 0, (k % 40 + 2).cast("double")).alias("h"), F.when(k % 3 == 0, F.concat(F.lit("s"), (k * 6).cast("string"))).alias("source"))
    small = sites(spark, d).withColumns({"x0": F.col("x0") + 390 - k % 9 * 45, "x1": F.col("x0") + 600 + k % 7 * 20})
    h, floors = F.when(k % 4 == 0, (k % 50).cast("double")), F.when(k % 4 == 1, k % 6)
    aux = small.select(*K.BOX, h.alias("h"), floors.alias("floors"), F.concat(F.lit("kind"), (k % 3).cast("string")).alias("kind"), (k % 29 == 0).alias("underground"), F.concat(F.lit("s"), k.cast("string")).alias("source"))
    profiles = aux.select("kind").distinct().withColumn("height", F.length("kind") + F.substring("kind", 5, 1).cast("double"))
    return K.Sources(base, aux, pieces(spark, d), profiles)


FUSED = f"""WITH RECURSIVE {OVER}, {PIECES},
base AS (SELECT id, x0, y0, x1, y1, CASE WHEN id % 5 > 0 THEN CAST(id % 40 + 2 AS DOUBLE) END AS h, CASE WHEN id % 3 = 0 THEN 's' || (id * 6) END AS source FROM plots),
aux AS (SELECT id, x0 + 390 - id % 9 * 45 AS x0, y0, x0 + 600 + id % 7 * 20 AS x1, y1, CASE WHEN id % 4 = 0 THEN CAST(id % 50 AS DOUBLE) END AS h, CASE WHEN id % 4 = 1 THEN id % 6 END AS floors, 'kind' || (id % 3) AS kind, id % 29 = 0 AS underground, 's' || id AS source FROM sites),
common AS (SELECT a.id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS c, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM aux a JOIN base b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
iou AS (SELECT id, max(c / (s - c)) AS iou FROM common GROUP BY id),
judged AS (SELECT a.*, CASE WHEN underground THEN 'underground' WHEN a.source IN (SELECT source FROM base WHERE source IS NOT NULL) THEN 'duplicate id' WHEN iou >= 0.5 THEN 'duplicate overlap' WHEN iou IS NOT NULL THEN 'conflict' END AS verdict FROM aux a LEFT JOIN iou USING (id)),
free AS (SELECT * FROM judged WHERE verdict IS NULL),
lent AS (SELECT f.id, median(b.h) AS m FROM free f JOIN base b ON b.h IS NOT NULL AND pow(trunc((f.x0 + f.x1) / 2) - trunc((b.x0 + b.x1) / 2), 2) + pow(trunc((f.y0 + f.y1) / 2) - trunc((b.y0 + b.y1) / 2), 2) <= 36000000 GROUP BY f.id HAVING count(*) >= 3),
tall AS (SELECT f.*, CASE WHEN h > 0 THEN h WHEN floors > 0 THEN floors * 3.0 ELSE coalesce(m, 5 + CAST(kind[5] AS INT)) END AS height, CASE WHEN h > 0 THEN 'auxiliary:height' WHEN floors > 0 THEN 'auxiliary:floors' WHEN m IS NOT NULL THEN 'context:neighbour_median' ELSE 'context:profile' END AS basis FROM free f LEFT JOIN lent USING (id)),
topped AS (SELECT id, x0, y0, x1, y1, 0.0 AS base, height AS top FROM tall), {_hits('topped')},
able AS (SELECT * FROM tall WHERE id NOT IN (SELECT id FROM hits)),
p AS (SELECT a.id AS early, b.id AS late FROM able a JOIN able b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
r(id, kept) USING KEY (id) AS (SELECT id, true FROM able WHERE id NOT IN (SELECT late FROM p) UNION SELECT late, NOT bool_or(coalesce(k.kept, false)) FROM p LEFT JOIN recurring.r AS k ON k.id = early WHERE late NOT IN (SELECT id FROM recurring.r) AND EXISTS (SELECT 1 FROM r) GROUP BY late HAVING bool_or(coalesce(k.kept, false)) OR count(k.id) = count(*)),
added AS (SELECT able.* FROM able JOIN r USING (id) WHERE kept),
result AS (SELECT j.id, coalesce(j.verdict, CASE WHEN a.id IS NOT NULL THEN 'added' WHEN EXISTS (SELECT 1 FROM added b WHERE b.id < j.id AND b.x0 < j.x1 AND j.x0 < b.x1 AND b.y0 < j.y1 AND j.y0 < b.y1) THEN 'conflict' ELSE 'road conflict' END) AS verdict, CAST(a.height AS DOUBLE) AS height, a.basis FROM judged j LEFT JOIN added a ON a.id = j.id)"""


@query("pip04_fusion", f"{FUSED} SELECT * FROM result")
def _(spark, d):
    return K.fuse_sources(sources(spark, d), 4000)


@query("pip04_fusion_report", f"{FUSED} SELECT verdict, basis, count(*) AS n FROM result GROUP BY ALL")
def _(spark, d):
    return K.report(K.fuse_sources(sources(spark, d), 4000))


@query("pip04_incremental", f"{FUSED} SELECT * FROM result")
def _(spark, d):
    """From a run over other sources (a tenth of the footprints elsewhere, one kind's profile changed) and the changed cells alone."""
    now = sources(spark, d)
    moved = F.when(F.col("id") % 10 == 3, 2000).otherwise(0)
    aux = now.auxiliary.withColumns({"x0": F.col("x0") + moved, "x1": F.col("x1") + moved})
    old = K.Sources(now.base.withColumn("source", F.when(F.col("id") % 7 > 0, F.col("source"))), aux, now.segs, now.profiles.withColumn("height", F.col("height") + (F.col("kind") == "kind1").cast("int")))
    changed = K.changed_cells(K.signatures(old, 4000), K.signatures(now, 4000))
    return K.refuse_changed(now, changed, K.fuse_sources(old, 4000), 4000)[0]
