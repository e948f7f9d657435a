"""Exact values on small frames for what the catalogue's tables do not show."""

import random

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import rules as R
from geoloom.operators import changes as C
from geoloom.operators import fusion as U
from geoloom.operators import graph as GR
from geoloom.operators import references as REF
from geoloom.plans import catalog
from geoloom.streaming.progress import throttled_stream


def test_utm(spark):
    df = spark.createDataFrame([(12.0, 56.0, 9.0, False, 687071.44, 6210141.33), (174.0, -44.0, 171.0, True, 740526.32, 5123750.87)], "lon double, lat double, o double, south boolean, e double, n double")
    for r in df.collect():
        got = spark.range(1).select(*G.utm(F.lit(r.lon), F.lit(r.lat), r.o, r.south)).first()
        assert abs(got[0] - r.e) < 0.01 and abs(got[1] - r.n) < 0.01


def test_rings_and_seeds(spark):
    row = spark.createDataFrame([([7, 3, 9, 5],), ([3, 7, 5, 9],)], "v array<long>").select(G.canonical_ring(F.col("v"))).collect()
    assert row[0][0] == row[1][0] == [3, 7, 5, 9]
    import hashlib

    want = int.from_bytes(hashlib.sha256("storeys\x1fa1".encode()).digest()[:8], "big") % 13
    assert spark.range(1).select(G.seeded(13, F.lit("storeys"), F.lit("a1"))).first()[0] == want


def test_rules(spark):
    tags = lambda **t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    one = spark.range(1)
    got = one.select(
        R.category(tags(highway="residential", building="yes")), R.category(tags(barrier="fence")), R.category(tags(barrier="fence"), city=True), R.tree_hint(tags(genus="Prunus")), R.tree_hint(tags(leaf_type="needleleaved")),
        R.tree_hint(tags(name="oak")), R.oneway(tags(junction="roundabout")), R.off_ground(tags(bridge="no")), R.off_ground(tags(layer="1")), R.profile_height(F.lit("detached"), F.lit("rural")), R.profile_height(F.lit("office"), F.lit("urban")), R.sidewalk_cm(F.lit(0.4)), R.sidewalk_cm(F.lit(2.0)),
    ).first()
    assert list(got) == ["ambiguous", None, "barrier", "cherry", "pine", "tree", 1, False, True, 5, 12, 20, 67]


def test_changes_refuse_stale_and_repeated(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    fine = C.diff(base, spark.createDataFrame([(1, "x"), (3, "c")], "id long, v string"), "id")
    out, faults = C.apply_changes(base, fine, "id")
    assert {tuple(r) for r in out.collect()} == {(1, "x"), (3, "c")} and faults.count() == 0
    out, faults = C.apply_changes(base, C.reverse(fine), "id")
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "b")} and {r.fault for r in faults.collect()} == {"stale"}
    out, faults = C.apply_changes(base, fine.unionByName(fine), "id")
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "b")} and {r.fault for r in faults.collect()} == {"repeated"}


def test_overrides_and_fills(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id long, h double")
    out, lost = REF.apply_overrides(rows, spark.createDataFrame([(1, 6.0), (9, 1.0)], "id long, h double"), "id", ["h"])
    assert {tuple(r) for r in out.collect()} == {(1, 5.0), (2, None), (3, 7.0)} and lost.count() == 1
    out, faults = REF.fill_missing(rows, spark.createDataFrame([(2, 4.0), (3, 8.0), (9, 1.0)], "id long, h double"), "id", "h")
    assert {tuple(r) for r in out.collect()} == {(1, 5.0), (2, 4.0), (3, 7.0)} and {tuple(r) for r in faults.collect()} == {(3, "conflict"), (9, "unknown")}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (5, 5)], "a long, b long")
    assert {tuple(r) for r in GR.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (5, 5)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.component for r in GR.components(chain).collect()} == {0}
    way = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 4)], "way long, node long")
    got = GR.closure(spark.createDataFrame([(1,)], "way long"), way, spark.createDataFrame([(1,), (2,)], "way long"))
    assert {tuple(r) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}
    weighted = edges.withColumn("length", F.lit(2.0))
    assert {tuple(r) for r in GR.distances(weighted, spark.createDataFrame([(1,)], "node long"), 4.0).collect()} == {(1, 0.0), (2, 2.0), (3, 4.0)}
    pairs = spark.createDataFrame([(1, 4), (1, 10)], "start long, goal long")
    assert [tuple(r) for r in GR.route(edges, pairs, 5).collect()] == [(1, 4, 3)]
    signed = spark.createDataFrame([(1, 1, 2, "x"), (2, 2, 3, "x"), (3, 3, 4, "y")], "edge long, a long, b long, s string")
    assert {tuple(r) for r in GR.chains(signed, "s").collect()} == {(1, 1), (2, 1), (3, 3)}


def test_rings_from_ways(spark):
    ways = spark.createDataFrame([(1, 10, [1, 2, 3]), (1, 11, [1, 4, 3]), (2, 12, [5, 6, 7]), (3, 13, [8, 9, 8]), (4, 14, [1, 2, 3, 2, 4, 1])], "relation long, way long, nodes array<long>")
    rings, faults = U.assemble_rings(ways)
    assert [r.node for r in rings.where("relation = 1").orderBy("seq").collect()] == [1, 2, 3, 4]
    assert {tuple(r) for r in faults.collect()} == {(2, "open"), (4, "repeated node")} and rings.where("relation = 4").count() == 0 and rings.where("relation = 3").count() == 2


def test_greedy_and_simplify(spark):
    pts = spark.createDataFrame([(1, 0, 0), (2, 5, 0), (3, 12, 0), (4, 100, 0)], "id long, x long, y long")
    assert {r.id for r in U.greedy_apart(pts, 8, ["id"]).collect()} == {1, 3, 4}
    line = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 5, 1), (1, 2, 10, 0), (1, 3, 10, 10)], "id long, seq long, x long, y long")
    assert [r.seq for r in U.simplify(line, 2.0).orderBy("seq").collect()] == [0, 2, 3]


def test_lines_are_simplified_in_a_stream(spark):
    """No Python call a line; lines that Arrow batches cut, single vertices, kept ones and null ids come out as line by line."""
    rng = random.Random(5)
    rows = [(i if i else None, k, rng.randrange(9), rng.randrange(9), rng.random() < 0.1) for i in range(30) for k in range(rng.choice([1, 2, 3, 8, 20]))]
    rng.shuffle(rows)

    def kept(line, tol=2.0):
        stay, work = {0, len(line) - 1} | {i for i, r in enumerate(line) if r[4]}, []
        work = list(zip(sorted(stay), sorted(stay)[1:], strict=False))
        while work:
            a, b = work.pop()
            (ax, ay), (bx, by) = line[a][2:4], line[b][2:4]
            dx, dy, best, at = bx - ax, by - ay, tol * tol, None
            for i in range(a + 1, b):
                px, py = line[i][2] - ax, line[i][3] - ay
                t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                d2 = (px - t * dx) ** 2 + (py - t * dy) ** 2
                if d2 > best:
                    best, at = d2, i
            if at is not None:
                stay.add(at)
                work += [(a, at), (at, b)]
        return [line[i] for i in stay]

    want = [r for key in {r[0] for r in rows} for r in kept(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = U.simplify(spark.createDataFrame(rows, "id long, seq long, x long, y long, hold boolean"), 2.0, "hold")
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
        assert U.simplify(df.where("false"), 2.0, "hold").collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().toString()


def test_greedy_in_rounds(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(300), rng.randrange(300), rng.choice([None, *range(40)])) for i in range(400)]
    keep = []
    for i, x, y, _ in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[0])):
        if all((x - u) ** 2 + (y - v) ** 2 > 900 for _, u, v in keep):
            keep.append((i, x, y))
    df = U.greedy_apart(spark.createDataFrame(rows, "id long, x long, y long, w long"), 30, ["w"])
    assert sorted(tuple(r)[:3] for r in df.collect()) == sorted(keep)
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().toString()  # no group decides for all its points in one task


def test_nearest_line_without_a_global_window(spark):
    plan = catalog.QUERIES["jon19_nearest_line"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_connectors(spark):
    uses = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "id long, connector string")
    segs = spark.createDataFrame([(1, 0, 0, 10, 0)], "id long, x long, y long, x2 long, y2 long")
    known = spark.createDataFrame([("a", 5, 0), ("b", 5, 9), ("c", 0, 0), ("c", 1, 0)], "connector string, x long, y long")
    assert {(r.connector, r.fault) for r in U.connector_faults(uses, segs, known, 1.0).collect()} == {("b", "off the line"), ("c", "repeated"), ("d", "unknown")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00.010", 1), (1, "a", "2024-01-01 00:00:00.050", 2), (1, "a", "2024-01-01 00:00:00.150", 3), (1, "a", "2024-01-01 00:01:00", 4)], "request long, stage string, ts string, seq long").select("request", "stage", F.to_timestamp("ts").alias("ts"), "seq").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("request long, stage string, ts timestamp, seq long").parquet(str(tmp_path / "in"))
    found = throttled_stream(events, ["request", "stage"], "ts", "seq", late="1 second")
    run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2, 3}
