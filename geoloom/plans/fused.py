"""Queries over matching, fusion, cell paint, raster statistics and further aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import aggregates as A
from geoloom.operators import fusion as U
from geoloom.operators import sequences as S
from geoloom.plans.base import BOXES, HOMES, LINES, NODES, SHOPS, WAY_NODES, boxes, homes, lines, nodes, query, shops, table, way_nodes
from geoloom.plans.space import RASTER, _raster, _span

SITES = "sites AS (SELECT id, (x // 500) * 500 AS x0, (y // 500) * 500 AS y0, (x // 500) * 500 + 300 + id % 7 * 40 AS x1, (y // 500) * 500 + 420 - id % 5 * 30 AS y1, id % 3 = 0 AS tall FROM homes)"
PLOTS = "plots AS (SELECT id, (x // 500) * 500 + 20 AS x0, (y // 500) * 500 AS y0, (x // 500) * 500 + 380 AS x1, (y // 500) * 500 + 400 AS y1 FROM shops)"
OVER = f"{HOMES}, {SHOPS}, {SITES}, {PLOTS}, o AS (SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS c, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t, a.tall FROM sites a JOIN plots b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"


def sites(spark, d):
    x, y, k = F.floor(F.col("x") / 500) * 500, F.floor(F.col("y") / 500) * 500, F.col("id")
    return homes(spark, d).select("id", x.alias("x0"), y.alias("y0"), (x + 300 + k % 7 * 40).alias("x1"), (y + 420 - k % 5 * 30).alias("y1"), (k % 3 == 0).alias("tall"))


def plots(spark, d):
    x, y = F.floor(F.col("x") / 500) * 500, F.floor(F.col("y") / 500) * 500
    return shops(spark, d).select("id", (x + 20).alias("x0"), y.alias("y0"), (x + 380).alias("x1"), (y + 400).alias("y1"))


@query("jon13_best_match", f"WITH {OVER} SELECT a AS a_id, CAST(min_by(b, -(c / (s + t - c)) * 1000000 + b / 1000000.0) AS BIGINT) AS b_id FROM o WHERE c / (s + t - c) >= 0.5 GROUP BY a")
def _(spark, d):
    return U.best_match(sites(spark, d), plots(spark, d), 500, 0.5).select("a_id", "b_id")


@query("jon34_fused", f"WITH {OVER}, m AS (SELECT a, max(c / (s + t - c)) AS iou FROM o GROUP BY a) SELECT h.id, CASE WHEN iou >= 0.5 THEN 'duplicate' WHEN iou IS NOT NULL THEN 'conflict' ELSE 'added' END AS verdict FROM sites h LEFT JOIN m ON m.a = h.id")
def _(spark, d):
    return U.fuse(plots(spark, d), sites(spark, d), 500, 0.5)


@query("agg10_coverage", f"WITH {OVER} SELECT p.id, round(coalesce(sum(o.c) / ((p.x1 - p.x0) * (p.y1 - p.y0)), 0), 6) AS share, CAST(coalesce(sum(o.tall::INT), 0) AS BIGINT) AS tall FROM plots p LEFT JOIN o ON o.b = p.id GROUP BY p.id, p.x0, p.x1, p.y0, p.y1")
def _(spark, d):
    return U.coverage(plots(spark, d), sites(spark, d), 500).select("id", F.round("share", 6).alias("share"), "tall")


@query("cel01_paint", f"WITH {BOXES}, p AS (SELECT *, id % 4 AS priority, 'style' || (id % 3) AS style, id % 9 = 8 AS blocked FROM boxes), c AS (SELECT x.cx, y.cy, p.* FROM p JOIN (SELECT unnest(range(0, (SELECT max(x1) // 100 + 1 FROM boxes))) AS cx) x ON x.cx * 100 + 50 BETWEEN p.x0 AND p.x1 JOIN (SELECT unnest(range(0, 120)) AS cy) y ON y.cy * 100 + 50 BETWEEN p.y0 AND p.y1) SELECT cx, cy, min_by(id, priority * 10000000000 + id % 3 * 1000000000 + id) AS id, min_by(style, priority * 10000000000 + id % 3 * 1000000000 + id) AS style, count(*) AS contributing FROM c GROUP BY cx, cy HAVING NOT bool_or(blocked)")
def painted(spark, d):
    k = F.col("id")
    return U.paint(boxes(spark, d).withColumns({"priority": k % 4, "style": F.concat(F.lit("style"), (k % 3).cast("string")), "blocked": k % 9 == 8}), 100)


@query("agg23_cover_area", f"WITH {BOXES}, p AS (SELECT *, id % 4 AS priority, 'style' || (id % 3) AS style, id % 9 = 8 AS blocked FROM boxes), c AS (SELECT x.cx, y.cy, p.* FROM p JOIN (SELECT unnest(range(0, (SELECT max(x1) // 100 + 1 FROM boxes))) AS cx) x ON x.cx * 100 + 50 BETWEEN p.x0 AND p.x1 JOIN (SELECT unnest(range(0, 120)) AS cy) y ON y.cy * 100 + 50 BETWEEN p.y0 AND p.y1), m AS (SELECT min_by(style, priority * 10000000000 + id % 3 * 1000000000 + id) AS style FROM c GROUP BY cx, cy HAVING NOT bool_or(blocked)) SELECT style, count(*) * 10000 AS area FROM m GROUP BY style")
def _(spark, d):
    return painted(spark, d).groupBy("style").agg((F.count(F.lit(1)) * 10000).alias("area"))


@query("jon30_tile_samples", f"WITH {RASTER}, p AS (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 41 % 630) / 10.0 AS x, (c_custkey * 59 % (SELECT max(vec_id) * 10 FROM embeddings)) / 10.0 AS y FROM customer), k AS (SELECT id, floor(x) AS c, floor(y) AS r, x - floor(x) AS u, y - floor(y) AS v FROM p) SELECT k.id, CAST(round(10000 * (a.h * (1 - u) * (1 - v) + b.h * u * (1 - v) + e.h * (1 - u) * v + f.h * u * v)) AS BIGINT) AS h FROM k JOIN g a ON a.row = r AND a.col = c JOIN g b ON b.row = r AND b.col = c + 1 JOIN g e ON e.row = r + 1 AND e.col = c JOIN g f ON f.row = r + 1 AND f.col = c + 1")
def _(spark, d):
    k = F.col("c_custkey").cast("bigint")
    pts = table(spark, d, "customer").select(k.alias("id"), (k * 41 % 630 / 10.0).alias("x"), (k * 59 % _span(spark, d) / 10.0).alias("y"))
    tiles = _raster(spark, d).select(F.floor(F.col("col") / 16).alias("tx"), F.floor(F.col("row") / 16).alias("ty"), (F.col("row") % 16).alias("row"), (F.col("col") % 16).alias("col"), "h")
    return U.tile_samples(pts, tiles, 16).select("id", F.round(F.col("h") * 10000).cast("bigint").alias("h"))


@query("agg26_shore_levels", "SELECT vec_id AS id, min(h) AS low, median(h) AS middle, max(h) AS high, count(*) AS n FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS h FROM embeddings) GROUP BY vec_id")
def _(spark, d):
    return U.ground_levels(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.col("embedding").cast("array<double>")).alias("h")))


@query("agg19_blocks_touched", f"WITH {RASTER} SELECT tile, count(*) AS blocks, count(*) * 1024 AS bytes FROM (SELECT DISTINCT row % 3 AS tile, row // 8 AS r, col // 16 AS c FROM g WHERE h > 0.2) GROUP BY tile")
def _(spark, d):
    return U.blocks_touched(_raster(spark, d).where("h > 0.2").withColumn("tile", F.col("row") % 3), 8, 16, 1024)


@query("sca18_quantised", f"WITH {RASTER}, t AS (SELECT row % 4 AS tile, row, col, h, min(h) OVER (PARTITION BY row % 4) AS low FROM g) SELECT tile, row, col, CAST(round_even((h - low) / 0.125, 0) AS BIGINT) AS q FROM t")
def _(spark, d):
    return U.quantised(_raster(spark, d).withColumn("tile", F.col("row") % 4), 0.125).select("tile", "row", "col", "q")


@query("jon32_inserted_rows", f"WITH {LINES}, p AS (SELECT id, seq, x, y, ref AS a, lead(ref) OVER w AS b FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq)), e AS (SELECT * FROM p WHERE seq = 1 AND b IS NOT NULL), h AS (SELECT e.id, e.x, e.y, min(p.seq) AS seq FROM e JOIN p ON p.id = e.id AND least(p.a, p.b) = least(e.a, e.b) AND greatest(p.a, p.b) = greatest(e.a, e.b) GROUP BY e.id, e.x, e.y HAVING count(*) = 1) SELECT id, row_number() OVER (PARTITION BY id ORDER BY seq) AS seq, ref, x, y FROM (SELECT id, seq, ref, x, y FROM lines UNION ALL SELECT id, seq + 0.5, NULL, x, y FROM h)")
def _(spark, d):
    w = lines(spark, d)
    pairs = w.select("id", "seq", F.col("ref").alias("a"), F.lead("ref").over(Window.partitionBy("id").orderBy("seq")).alias("b"), "x", "y").where("seq = 1 AND b IS NOT NULL")
    return U.insert_points(w, pairs.select("id", "b", "a", "x", "y"))[0].select("id", F.col("seq").cast("bigint").alias("seq"), "ref", "x", "y")


@query("jon32_inserted", f"WITH {WAY_NODES}, p AS (SELECT id, seq, ref AS a, lead(ref) OVER w AS b, lead(seq) OVER w AS seq2 FROM way_nodes WINDOW w AS (PARTITION BY id ORDER BY seq)), e AS (SELECT id, a, b FROM p WHERE seq = 1 AND b IS NOT NULL), h AS (SELECT e.id, e.a, e.b, count(*) AS n FROM e JOIN p ON p.id = e.id AND least(p.a, p.b) = least(e.a, e.b) AND greatest(p.a, p.b) = greatest(e.a, e.b) GROUP BY ALL), s AS (SELECT id, count(*) AS n FROM way_nodes GROUP BY id) SELECT s.id, s.n + coalesce(CASE WHEN h.n = 1 THEN 1 END, 0) AS vertices FROM s LEFT JOIN h ON h.id = s.id")
def _(spark, d):
    w = lines(spark, d)
    pairs = w.select("id", "seq", F.col("ref").alias("a"), F.lead("ref").over(Window.partitionBy("id").orderBy("seq")).alias("b"), "x", "y").where("seq = 1 AND b IS NOT NULL")
    return U.insert_points(w, pairs.select("id", "b", "a", "x", "y"))[0].groupBy("id").agg(F.count(F.lit(1)).alias("vertices"))


@query("jon47_kept_chains", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 = 3)")
def _(spark, d):
    return U.keep_chains(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", F.col("l_partkey") % 50 == 3)


@query("prj32_country_defaults", f"WITH {HOMES}, p AS (SELECT id, id % 6 AS country, x, y FROM homes), b AS (SELECT *, row_number() OVER () AS o FROM (VALUES (0, 1, 0, 0, 4000, 9999, 'cold'), (0, 2, 0, 0, 8000, 5000, 'arid'), (3, 1, 5000, 0, 9999, 9999, 'humid')) v(country, ord, west, south, east, north, climate)) SELECT p.id, coalesce((SELECT min_by(climate, ord) FROM b WHERE b.country = p.country AND x BETWEEN west AND east AND y BETWEEN south AND north), CASE WHEN country < 5 THEN 'climate ' || country END) AS climate FROM p")
def _(spark, d):
    k = F.col("id")
    places = homes(spark, d).select("id", (k % 6).alias("country"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    own = boxes(spark, d).where("id < 5").select(F.col("id").alias("country"), F.concat(F.lit("climate "), k.cast("string")).alias("climate"))
    areas = spark.createDataFrame([(0, 1, 0, 0, 4000, 9999, "cold"), (0, 2, 0, 0, 8000, 5000, "arid"), (3, 1, 5000, 0, 9999, 9999, "humid")], "country long, ord int, west long, south long, east long, north long, climate string")
    return U.country_defaults(places, own, areas).select("id", "climate")


@query("prj01_window", f"WITH {NODES} SELECT id, x, y FROM nodes WHERE x BETWEEN 10000 AND 60000 AND y BETWEEN 5000 AND 50000")
def _(spark, d):
    return nodes(spark, d).where(F.col("x").between(10000, 60000) & F.col("y").between(5000, 50000))


@query("agg17_feature_counts", "SELECT p_type, count(*) AS n, CAST(sum((p_size > 25)::INT) AS BIGINT) AS large, CAST(sum((p_retailprice > 1000)::INT) AS BIGINT) AS dear FROM part GROUP BY p_type")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"))


@query("agg18_estimates", f"WITH {WAY_NODES} SELECT id, CAST(sum((ref % 3 = 0)::INT) AS BIGINT) AS estimated, count(*) AS n FROM way_nodes GROUP BY id")
def _(spark, d):
    return way_nodes(spark, d).groupBy("id").agg(F.count_if(F.col("ref") % 3 == 0).alias("estimated"), F.count(F.lit(1)).alias("n"))


@query("win15_greedy_apart", f"WITH RECURSIVE {HOMES}, p AS (SELECT a.id AS early, b.id AS late FROM homes a JOIN homes b ON a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 22500), r(id, kept) USING KEY (id) AS (SELECT id, true FROM homes WHERE id NOT IN (SELECT late FROM p) UNION SELECT late, NOT bool_or(coalesce(k.kept, false)) FROM p LEFT JOIN recurring.r AS k ON k.id = early WHERE late NOT IN (SELECT id FROM recurring.r) AND EXISTS (SELECT 1 FROM r) GROUP BY late HAVING bool_or(coalesce(k.kept, false)) OR count(k.id) = count(*)) SELECT id, x, y FROM homes JOIN r USING (id) WHERE kept")
def _(spark, d):
    return U.greedy_apart(homes(spark, d), 150, ["id"])


#: Directions in fifths, by stretches of ids. Fixed values of the fixture, as the SQL has them.
WAYS = ((5, 0), (3, 4), (0, 5), (-4, 3))


@query("win15_heading", f"WITH RECURSIVE {HOMES}, w AS (SELECT *, id // 40 % 3 AS kind, [5, 3, 0, -4][id // 60 % 4 + 1] AS hx, [0, 4, 5, 3][id // 60 % 4 + 1] AS hy FROM homes), p AS (SELECT a.id AS early, b.id AS late FROM w a JOIN w b ON a.id < b.id AND a.kind = b.kind AND a.hx * b.hx + a.hy * b.hy >= 15 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 160000), r(id, kept) USING KEY (id) AS (SELECT id, true FROM homes WHERE id NOT IN (SELECT late FROM p) UNION SELECT late, NOT bool_or(coalesce(k.kept, false)) FROM p LEFT JOIN recurring.r AS k ON k.id = early WHERE late NOT IN (SELECT id FROM recurring.r) AND EXISTS (SELECT 1 FROM r) GROUP BY late HAVING bool_or(coalesce(k.kept, false)) OR count(k.id) = count(*)) SELECT id, kind, hx, hy FROM w JOIN r USING (id) WHERE kept")
def _(spark, d):
    k = F.col("id")
    way = lambda i: F.element_at(F.array(*[F.lit(w[i]) for w in WAYS]), (F.floor(k / 60) % 4 + 1).cast("int"))
    signs = homes(spark, d).withColumns({"kind": F.floor(k / 40) % 3, "hx": way(0), "hy": way(1)})
    return U.greedy_apart(signs, 400, ["id"], ("hx", "hy"), 15, "kind").select("id", "kind", "hx", "hy")


@query("win20_simplified")
def _(spark, d):
    return U.simplify(lines(spark, d).select("id", "seq", "x", "y"), 15000.0)


@query("agg33_cell_signatures", f"WITH {NODES} SELECT x // 5000 AS cx, y // 5000 AS cy, count(*) AS n, CAST(sum(('0x' || substr(sha256(concat_ws('|', id, x, y)), 1, 15))::BIGINT) AS VARCHAR) AS signature FROM nodes GROUP BY ALL")
def _(spark, d):
    rows = nodes(spark, d).select(F.floor(F.col("x") / 5000).alias("cx"), F.floor(F.col("y") / 5000).alias("cy"), F.concat_ws("|", "id", "x", "y").alias("record"))
    return A.cell_signatures(rows)


@query("top05_largest_rings", f"WITH {LINES}, e AS (SELECT id, x, y, coalesce(lead(x) OVER w, first(x) OVER f) AS x2, coalesce(lead(y) OVER w, first(y) OVER f) AS y2 FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq), f AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT id, CAST(abs(sum(x * y2 - x2 * y)) AS BIGINT) AS area2 FROM e GROUP BY id ORDER BY area2 DESC, id LIMIT 16")
def _(spark, d):
    e = S.segments(lines(spark, d), closed=True)
    return e.groupBy("id").agg(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))).alias("area2")).orderBy(F.desc("area2"), "id").limit(16)
