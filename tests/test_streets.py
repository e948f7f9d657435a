"""Streets and published rows on small worked examples."""

from geoloom.operators import parallels as A
from geoloom.operators import sequences as S
from geoloom.operators import streets as T
from geoloom.sources import overlays

SEG = "id long, seq long, x long, y long, x2 long, y2 long"


def _ring(i, *pts):
    return [(i, k, *a, *b) for k, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]


def test_wet_length_counts_shared_water_once_and_dry_lines(spark):
    water = _ring(1, (10, -5), (20, -5), (20, 5), (10, 5)) + _ring(2, (15, -5), (40, -5), (40, 5), (15, 5)) + _ring(3, (24, -1), (26, -1), (26, 1), (24, 1))
    edges = spark.createDataFrame(water, SEG)
    lines = spark.createDataFrame([(1, 0, 0, 0, 30, 0), (1, 1, 30, 0, 30, 90), (2, 0, 0, 50, 9, 50), (3, 0, 12, 0, 12, 0)], SEG)
    assert {r.id: round(r.wet, 6) for r in T.wet_length(lines, edges, 10).collect()} == {1: 25.0, 2: 0.0, 3: 0.0}
    assert T.wet_length(lines.limit(0), edges, 10).count() == 0
    assert {r.wet for r in T.wet_length(lines, edges.limit(0), 10).collect()} == {0.0}


def test_gates_and_crossings_cut_a_barrier(spark):
    barrier = spark.createDataFrame([(1, 0, 0, 0, 100, 0), (1, 1, 100, 0, 100, 100), (2, 0, 0, 500, 10, 500)], SEG)
    ways = spark.createDataFrame([(9, 0, 50, -5, 50, 5, 10), (9, 1, 58, -5, 58, 5, 10)], f"{SEG}, width long")
    gates = spark.createDataFrame([(7, 100, 60, 20), (8, 300, 300, 20)], "id long, x long, y long, width long")
    got = sorted(tuple(round(float(v), 6) for v in r) for r in T.gate_cuts(barrier, ways, gates, 50, 1.0).collect())
    assert got == [(1, 0, 44), (1, 64, 150), (1, 170, 200), (2, 0, 10)]


def test_sides_and_opposite(spark):
    roads = spark.createDataFrame([(1, 0, 0, 0, 100, 0, 10, 1), (2, 0, 100, 30, 0, 30, 10, 1), (3, 0, 0, -30, 100, -30, 10, 1), (4, 0, 5, 5, 5, 5, 10, 1), (5, 0, 0, 40, 100, 40, 10, None)], f"{SEG}, width long, one_way int")
    points = spark.createDataFrame([(1, 50, 3), (2, 50, -3), (3, 50, 0), (4, 50, 900)], "id long, x long, y long")
    got = {tuple(r) for r in T.snap_to_side(points, roads.where("id = 1"), 20, 2.0).collect()}
    assert got == {(1, 1, 1, 50.0, 7.0), (2, 1, -1, 50.0, -7.0), (3, 1, 1, 50.0, 7.0)}
    assert {tuple(r) for r in T.opposite(roads, 1.0, 50.0, 20).collect()} == {(1, 0, 1, 2), (2, 0, 1, 1)}


def test_related_sites(spark):
    sites = spark.createDataFrame([(1, "a", 0, 0, 1), (2, "b", 5000, 0, 2), (3, "b", 90000, 0, 1), (4, "a", 91000, 0, None)], "id long, grp string, x long, y long, node long")
    rules = spark.createDataFrame([("a", "b"), ("a", "none"), ("b", "b")], "grp string, adjacent string")
    labels = spark.createDataFrame([(1, 1), (2, 2)], "node long, component long")
    got = {tuple(r) for r in T.related(sites, rules, labels, 100).collect()}
    assert got == {(1, "b", 2, False), (4, "b", 3, False), (2, "b", 3, False), (3, "b", 2, False)}
    assert T.related(sites.limit(0), rules, labels, 100).count() == 0


def test_sections_leave_closed_ways_whole(spark):
    ways = [(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 11), (2, 2, 20), (3, 1, 30), (3, 2, 31), (3, 3, 30), (4, 1, 40), (4, 2, 31), (4, 3, 20)]
    cut = T.sections(spark.createDataFrame(ways, "id long, seq long, ref long")).collect()
    pieces = {i: len({r.piece for r in cut if r.id == i}) for i in (1, 2, 3, 4)}
    assert pieces == {1: 2, 2: 1, 3: 1, 4: 1}
    rows = [(1, 0, True, True), (1, 1, False, True), (2, 0, True, False), (2, 1, False, False), (3, 0, False, False)]
    assert [tuple(r) for r in T.admitted(spark.createDataFrame(rows, "id long, piece long, ok boolean, structure boolean")).collect()] == [(2, 2, 1)]


def test_rows_with_nulls_keep_reasons(spark):
    point = "array<array<array<struct<x: double, y: double>>>>"
    shape = f"id string, type string, version int, height double, min_height double, has_parts boolean, is_underground boolean, building_id string, sources array<struct<dataset: string, license: string>>, geometry {point}"
    ring = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    good = ("b", None, 1, None, None, None, None, None, [("survey", None)], [[ring]])
    empty = (None,) * 10
    rows = spark.createDataFrame([good, empty, (*good[:8], [], [])], shape)
    got = [r.reasons for r in overlays.building_rows(rows, (0, 0, 5, 5)).collect()]
    assert got == [[], ["id", "ring", "sources"], ["ring", "sources"]]
    assert [r.reasons for r in overlays.building_rows(rows.limit(1), (0, 0, 5, 5), vertical=True).collect()] == [["vertical"]]
    cover = rows.selectExpr("id", "'forest' AS subtype", "8 AS min_zoom", "15 AS max_zoom", "sources", "geometry")
    assert [r.disposition for r in overlays.land_cover_rows(cover, (0, 0, 5, 5)).collect()] == ["forest", None, None]
    lines = spark.createDataFrame([(None,) * 9], "id string, type string, version int, subtype string, class string, level int, flags array<string>, sources array<struct<dataset: string>>, points array<struct<x: double, y: double>>")
    segments, connectors = overlays.transport_rows(lines, (0, 0, 5, 5), ["service"])
    assert segments.first().reasons == ["id", "version", "sources", "type", "line", "class"] and connectors.count() == 0


def test_parallels(spark):
    shape = f"{SEG}, width long, kind string"
    roads = spark.createDataFrame([(1, 0, 0, 0, 100, 0, 10, "a"), (2, 0, 100, 20, 0, 20, 10, "a"), (3, 0, 100, 10, 0, 10, 10, "b"), (4, 0, 0, -20, 100, -20, 10, "a"), (5, 0, 7, 7, 7, 7, 10, "a")], shape)
    got = {(r.id, r.partner, r.gap) for r in A.match_carriageways(roads, 10.0, 5.0, 50).collect()}
    assert got == {(1, 2, 20.0), (2, 1, 20.0), (4, 2, 40.0)}
    footways = spark.createDataFrame([(8, 0, 0, 8, 100, 8, 2), (9, 0, 0, -8, 30, -8, 2), (10, 0, 50, 5, 50, 60, 2)], f"{SEG}, width long")
    sides, pairs = A.match_sidewalks(roads.where("id = 1"), footways, 10.0, 6, 10)
    assert [tuple(r) for r in sides.collect()] == [(1, 1, 4.0)] and [tuple(r) for r in pairs.collect()] == [(1, 8)]
    bands = roads.where("id = 1").selectExpr("*", "9.25 AS band")
    both = spark.createDataFrame([(1, 8), (1, 10)], "road long, footway long")
    assert [tuple(r) for r in A.absorbed_footways(footways, bands, both, 10.0, 20).collect()] == [(8, 1)]
    assert A.match_carriageways(roads.limit(0), 10.0, 5.0, 50).count() == 0


def test_crop_leaves_and_comes_back(spark):
    rows = [(1, 1, 5, 5, 0), (1, 2, 15, 5, 10), (1, 3, 15, 8, 10), (1, 4, 5, 8, 0), (2, 1, 1, 1, 3), (2, 2, 1, 1, 3), (2, 3, 2, 1, 3), (3, 1, -5, 5, 0), (3, 2, 5, -5, 0), (4, 1, 9, 5, 0), (4, 2, 11, 5, 2)]
    kept, short = S.crop_lines(spark.createDataFrame(rows, "id long, seq long, x long, y long, z long"), (0, 0, 10, 10), 1.5)
    assert [tuple(r) for r in kept.where("id = 1").orderBy("piece", "seq").collect()] == [(1, 0, 1, 5, 5, 0, False), (1, 0, 2, 10, 5, 5, True), (1, 1, 1, 10, 8, 5, True), (1, 1, 2, 5, 8, 0, False)]
    assert {r.id for r in kept.collect()} == {1} and {tuple(r) for r in short.collect()} == {(2, 1), (4, 1)}
