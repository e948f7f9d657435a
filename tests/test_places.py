"""Geodesics, extents, places and spaces: known values and awkward cases."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geodesic as G
from geoloom.functions import styles as Y
from geoloom.operators import places as L
from geoloom.operators import spatial as P
from geoloom.operators.aggregates import group_records


def test_geodesics(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (9.0, 55.0, 9.0, 55.0), (0.0, 0.0, 180.0, 0.1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(1)
    got = [r.i for r in df.select(G.inverse("a", "b", "c", "d").alias("i")).collect()]
    assert got[0].metres == pytest.approx(110574.389, abs=1e-3) and got[0].azimuth == pytest.approx(0)
    assert got[1].metres == pytest.approx(111319.491, abs=1e-3) and got[1].azimuth == pytest.approx(90)
    assert got[2].metres == pytest.approx(0, abs=1e-6)
    assert got[3].metres is None or got[3].metres > 19_900_000


def test_points_in_polygons_needs_both_axes(spark):
    # two squares of one row of cells, far apart; a point between them lies in none
    square = lambda i, x: [(i, k, *e) for k, e in enumerate([(x, 0, x + 10, 0), (x + 10, 0, x + 10, 10), (x + 10, 10, x, 10), (x, 10, x, 0)])]
    edges = spark.createDataFrame(square(1, 0) + square(2, 1000), "id long, seq long, x long, y long, x2 long, y2 long")
    points = spark.createDataFrame([(1, 5, 5), (2, 500, 5), (3, 1005, 5), (4, 10, 5)], "id long, x long, y long")
    assert {tuple(r) for r in P.points_in_polygons(points, edges, 7).collect()} == {(1, 1), (3, 2), (4, 1)}
    assert {tuple(r) for r in P.points_in_polygons(points, edges, 7, boundary=False).collect()} == {(1, 1), (3, 2)}
    plan = P.points_in_polygons(points, edges, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "cx" in plan


def test_city_points_first_rule_decides(spark):
    rows = [({"tourism": "hotel", "shop": "mall", "name": " A "},), ({"tourism": "hotel", "shop": "mall"},), ({"natural": "tree", "species": "Prunus avium"},), ({},), (None,)]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame(rows, "tags map<string, string>").select(Y.city_point(F.col("tags")).alias("p")).collect()]
    assert got == [("poi", "shopping", 6, "A"), None, ("tree", "cherry", 0, ""), None, None]


def test_located_falls_back_to_the_only_country(spark):
    edge = [(1, 0, 0, 0, 10, 0), (1, 1, 10, 0, 10, 10), (1, 2, 10, 10, 0, 10), (1, 3, 0, 10, 0, 0)]
    edges = spark.createDataFrame(edge, "id long, seq long, x long, y long, x2 long, y2 long")
    areas = spark.createDataFrame([(1, 2, "AA", "", 5.0)], "id long, level int, country string, subdivision string, km2 double")
    points = spark.createDataFrame([(1, 5, 5), (2, 50, 50)], "id long, x long, y long")
    got = {r.id: (r.areas, r.code, r.basis) for r in L.located(points, areas, edges, 10).collect()}
    assert got == {1: ([1], "AA", "boundary"), 2: ([], "AA", "extract")}
    two = areas.union(areas.select(F.lit(2).cast("long"), "level", F.lit("BB"), "subdivision", "km2"))
    assert {r.id: r.basis for r in L.located(points, two, edges, 10).collect()} == {1: "boundary", 2: None}


def test_group_records_gathers_distinct_values(spark):
    rows = [(1, ["b", "a"], ["x"], False), (1, ["a", None], [], True), (2, [], None, False), (None, ["c"], ["y"], None)]
    df = spark.createDataFrame(rows, "k long, s array<string>, n array<string>, f boolean")
    got = {r.k: tuple(r)[1:] for r in group_records(df, "k", "s", "n", "f").collect()}
    assert got == {1: (["a", "b"], ["x"], True), 2: ([], [], False), None: (["c"], ["y"], None)}


def test_insert_or_ignore_keeps_one_new_row(spark):
    known, new = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "b")], "id long, v string")
    assert sorted(tuple(r) for r in L.insert_or_ignore(known, new).collect()) == [(1, "a"), (2, "b")]
