"""Tables whose rows are multiplied, or that are packed on disk, are never sent whole through the driver."""

import pytest
from pyspark.sql import functions as F

from geoloom.operators import spatial as P
from geoloom.operators.graph import SMALL, written
from geoloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["sca05_squares", "sca05_disks"])
def test_multiplied_rows_are_not_broadcast(spark, capsys, name):
    assert "BroadcastExchange" not in plan(catalog.QUERIES[name](spark, SF), capsys)


def test_ways_made_from_customers_are_not_broadcast(spark, capsys):
    from geoloom.plans.structure_queries import _town

    ways, vertices = _town(spark, SF)
    small = ways.where("candidate").select(F.col("id").alias("_w"))
    assert "Broadcast" not in plan(vertices.join(small, F.col("id") == F.col("_w")), capsys)


def test_cells_of_boxes_are_not_broadcast(spark, capsys):
    points = spark.range(50).select("id", F.col("id").alias("x"), F.col("id").alias("y"))
    segs = points.withColumns({"seq": F.lit(0), "x2": F.col("x") + 90, "y2": F.col("y") + 90})
    assert "Broadcast" not in plan(P.box_join(P.boxed_points(points), P.boxed_segments(segs), 10), capsys)
    assert "Broadcast" not in plan(P.segment_pairs(segs, segs, 10), capsys)


def test_written_tables_are_broadcast_by_what_they_hold(spark, capsys):
    few = written(spark.range(10).select(F.col("id").alias("k")))
    # two million rows in some megabytes: below Spark's limit for a broadcast by their files alone
    many = written(spark.range(0, 2_000_000, 1, 4).select((F.col("id") * 7).alias("k"), F.lit(1).alias("one")))
    big = spark.range(0, 4_000_000, 1, 4).select(F.col("id"), F.col("id").alias("other"), F.lit("x" * 50).alias("text"))
    assert SMALL < 10 << 20
    assert "BroadcastHashJoin" in plan(big.join(few, F.col("id") == F.col("k")), capsys)
    assert "BroadcastHashJoin" not in plan(big.join(many.select("k"), F.col("id") == F.col("k")), capsys)


def test_roads_and_pieces_made_from_customers_are_not_broadcast(spark, capsys):
    from geoloom.plans.carriageway_queries import _pieces

    each = _pieces(spark, SF)
    assert "Broadcast" not in plan(each.join(each.select(F.col("id").alias("_i")), F.col("id") == F.col("_i")), capsys)


def test_sidewalks_are_matched_once(spark, capsys):
    """What runs beside a road is found once, not again for each side, pair and footway."""
    assert "Generate" not in plan(catalog.QUERIES["jon24_sidewalks"](spark, SF), capsys)


def test_rows_to_be_multiplied_are_dealt_to_tasks(spark, capsys, monkeypatch):
    from geoloom.operators import fusion, terrain

    monkeypatch.setattr(P, "MADE", 100)
    few = spark.range(40).coalesce(1)
    assert P.spread(few, 10, "id").rdd.getNumPartitions() == 4 and P.spread(few.where("id < 0"), 10).rdd.getNumPartitions() == 1
    boxes = few.select("id", (F.col("id") * 100).alias("x0"), F.lit(0).alias("y0"), (F.col("id") * 100 + 500).alias("x1"), F.lit(300).alias("y1"), F.lit(1).alias("priority"), F.lit("a").alias("style"), F.lit(False).alias("blocked"))
    cells = few.select(F.col("id").alias("cx"), F.lit(0).cast("long").alias("cy"))
    for made in (fusion.paint(boxes, 100), terrain.sample_plan(cells, 9)):
        assert "REPARTITION_BY_NUM" in plan(made, capsys)
    assert fusion.paint(boxes, 100).count() == 44 * 3 and terrain.sample_plan(cells, 9).count() == 321 * 9


@pytest.mark.parametrize("name, before", [("win03_split_at_nodes", 6), ("pip01_cropped_lines", 4)])
def test_lines_are_sorted_and_read_once(spark, capsys, name, before):
    """Both rows of a cut vertex, and the numbers of cropped vertices, need no further pass or sort of all lines."""
    text = plan(catalog.QUERIES[name](spark, SF), capsys)
    assert "Union" not in text and text.count("Sort [") < before


def test_exact_road_conditions_are_not_part_of_the_join(spark, capsys, monkeypatch):
    """They made the join's method too long to be compiled; pairs are written first and judged once."""
    from geoloom.operators import composition as K

    made = []
    monkeypatch.setattr(K, "written", lambda df: made.append(df) or written(df))
    long = F.lit(0).cast("long")
    boxes = spark.range(4).select("id", (F.col("id") * 1000).alias("x0"), long.alias("y0"), (F.col("id") * 1000 + 400).alias("x1"), (long + 400).alias("y1"), F.lit(0.0).alias("base"), F.lit(3.0).alias("top"))
    segs = spark.range(4).select(F.col("id").alias("road"), long.alias("seq"), (F.col("id") * 1000).alias("x"), (F.col("id") * 200).alias("y"), (F.col("id") * 1000 + 300).alias("x2"), (F.col("id") * 200).alias("y2"), F.lit(0.0).alias("z"), F.lit(0.0).alias("z2"), F.lit(100).alias("width"), F.lit("ground").alias("kind"))
    found = K.road_conflicts(boxes, segs, 500)
    assert len(made) == 2 and "SQRT" not in plan(made[0], capsys) and "POWER" not in plan(made[0], capsys)
    assert "Generate" not in plan(found, capsys) and sorted(r.id for r in found.collect()) == [0, 1, 2]


def test_routes_are_the_same_with_cut_lists(spark, monkeypatch):
    """Lists of a hub's neighbours are cut by hash; each half of a way may be empty."""
    from geoloom.operators import graph as GR

    edges = spark.createDataFrame([(0, n) for n in range(1, 30)] + [(29, 30), (30, 31), (31, 32)], "a long, b long")
    pairs = spark.createDataFrame([(1, 2), (1, 31), (1, 32), (5, 5), (0, 7), (2, None)], "start long, goal long")
    for size in (1024, 4):
        monkeypatch.setattr(GR, "LIST", size)
        assert sorted(tuple(r) for r in GR.route(edges, pairs, 4).collect()) == [(0, 7, 1), (1, 2, 2), (1, 31, 4), (5, 5, 0)]
    assert sorted(tuple(r) for r in GR.route(edges, pairs, 1).collect()) == [(0, 7, 1), (5, 5, 0)]


def test_carriageways_are_matched_by_segments(spark, capsys):
    """Samples are made for pairs of segments; they are not dealt to cells one by one."""
    from geoloom.operators.parallels import match_carriageways

    segs = spark.createDataFrame([(1, 0, 0, 0, 400, 0, 0), (2, 0, 400, 100, 0, 100, 0), (3, 0, 0, 60, 400, 60, 1)], "id long, seq long, x long, y long, x2 long, y2 long, kind long")
    found = match_carriageways(segs, 50.0, 50.0, 700)
    text = plan(found, capsys)
    assert text.rindex("SortMergeJoin") > text.index("sequence(") and {(r.id, r.partner, r.gap) for r in found.collect()} == {(1, 2, 100.0), (2, 1, 100.0)} and found.count() == 16


@pytest.mark.parametrize("name", ["pip08_graph_faults", "gra10_level_ways"])
def test_inputs_used_again_are_written(spark, capsys, name):
    """Ways are numbered, and crossings found, once and not for each use."""
    text = plan(catalog.QUERIES[name](spark, SF), capsys)
    assert "LAG" not in text.upper() and text.count("lineitem.parquet") < 4 and "signum" not in text.lower()


def test_samples_are_made_for_pairs_of_segments(spark, capsys, monkeypatch):
    """Lines meet segment by segment; the samples' exact distances are no part of the join, whose method was too long to be compiled, and a long line has samples only beside what it meets."""
    from geoloom.operators import parallels as A

    made = []
    monkeypatch.setattr(A, "written", lambda df: made.append(df) or written(df))
    row = "id long, seq long, x long, y long, x2 long, y2 long, width long"
    roads = spark.createDataFrame([(1, 0, 0, 0, 400, 0, 40), (2, 0, 0, 5000, 100000, 5000, 40)], row)
    walks = spark.createDataFrame([(7, 0, 10, 30, 260, 30, 16), (8, 0, 50000, 5030, 50250, 5030, 16), (9, 0, 10, 900, 260, 900, 16)], row)
    sides, pairs = A.match_sidewalks(roads, walks, 50.0, 80, 80)
    assert {tuple(r) for r in pairs.collect()} == {(1, 7)} and [(r.id, r.side, r.offset) for r in sides.collect()] == [(1, 1, 18.0)]
    text = plan(made[0], capsys)
    assert "SortMergeJoin" in text and "a_k" not in text and "SQRT" not in text[: text.index("SortMergeJoin")]
    each = A._sampled(made[0], 50.0, 121)
    assert each.where("a_id = 2").count() < 20 and each.where("a_id = 1").count() == 8
    paired = spark.createDataFrame([(1, 7), (2, 8)], "road long, footway long")
    held = A.absorbed_footways(walks, roads.withColumn("band", F.lit(40.0)), paired, 50.0, 200)
    assert {tuple(r) for r in held.collect()} == {(7, 1), (8, 2)}


def test_cells_own_pairs_by_their_number(spark):
    """A pair of boxes comes once, by cells below zero and boxes of many cells too."""
    rows = [(n, n * 37 % 211 - 100, n * 53 % 199 - 90, n * 7 % 40, n * 11 % 60) for n in range(80)]
    boxes = spark.createDataFrame([(i, x, y, x + w, y + h) for i, x, y, w, h in rows], "id long, x0 long, y0 long, x1 long, y1 long")
    want = sorted((i, j) for i, x, y, w, h in rows for j, p, q, v, u in rows if x - 9 <= p + v and p - 9 <= x + w and y - 9 <= q + u and q - 9 <= y + h)
    for cell in (5, 16, 300):
        assert sorted(tuple(r) for r in P.box_join(boxes, boxes, cell, 9).select("a_id", "b_id").collect()) == want


def test_matched_samples_are_not_packed(spark, capsys):
    """Samples are many times the bytes of the pairs that they are made for, so adaptive execution may not pack these; and they are grouped without another shuffle."""
    from geoloom.operators.parallels import match_carriageways

    segs = spark.createDataFrame([(1, 0, 0, 0, 400, 0, 0), (2, 0, 400, 100, 0, 100, 0)], "id long, seq long, x long, y long, x2 long, y2 long, kind long")
    found = match_carriageways(segs, 50.0, 50.0, 700)
    text = plan(found, capsys)
    assert found.count() == 16 and text.count("REPARTITION_BY_NUM") == 1 and "Exchange" not in text[: text.index("Generate")]
