"""The transport graph's sweep against plain loops, and the heights of structures that interact."""

import random

from geoloom.operators import structures as T
from geoloom.operators import transport as X


def test_random_segments(spark):
    rng = random.Random(2)
    vertices, refs, connectors, rules, want = [], [], [], [], {}
    for i in range(60):
        xs = sorted(rng.sample(range(1, 64), rng.randint(0, 5)))
        line = [0, *xs, 64]
        vertices += [(i, n, x, i) for n, x in enumerate(line)]
        ties = sorted({0, 64, *rng.sample(range(1, 64), rng.randint(0, 4))})
        refs += [(i, i * 100 + t, t / 64) for t in ties]
        connectors += [(i * 100 + t, t, i) for t in ties]
        own = {}
        for layer in ("width", "surface"):
            if rng.random() < 0.8:
                cuts = [0, *sorted(rng.sample(range(1, 64), rng.randint(0, 3))), 64]
                own[layer] = [(a, b, rng.choice([None, 1, 2, 3])) for a, b in zip(cuts, cuts[1:], strict=False)]
                rules += [(i, layer, a / 64, b / 64, v) for a, b, v in own[layer]]
        marks = sorted({*line, *ties, *(a for r in own.values() for a, _, _ in r)})
        value = lambda layer, at: next((v for a, b, v in own.get(layer, []) if a <= at < b), None)  # noqa: B023, E731
        want[i] = [(sum(t <= a for t in ties) - 1, a / 64, b / 64, a, b, value("width", a), value("surface", a)) for a, b in zip(marks, marks[1:], strict=False)]
    frames = [spark.createDataFrame(r, s) for r, s in ((vertices, "id long, seq long, x long, y long"), (refs, "id long, connector long, at double"), (connectors + [(999999, 0, 0)], "connector long, x long, y long"), (rules, "id long, layer string, lo double, hi double, value long"))]
    pieces, roads, faults, unused = X.transport_graph(*frames, ["width", "surface"], 0.001)
    assert faults.isEmpty() and [r.connector for r in unused.collect()] == [999999]
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.id, r.lo)):
        got.setdefault(r.id, []).append((r.road, r.lo, r.hi, round(r.x, 9), round(r.x2, 9), r.width, r.surface))
    assert got == want
    assert {(r.id, r.start % 100 / 64, r.end % 100 / 64) for r in roads.collect()} == {(i, min(p[1] for p in ps if p[0] == n), max(p[2] for p in ps if p[0] == n)) for i, ps in want.items() for n in {p[0] for p in ps}}


def test_faults(spark):
    vertices = [(i, n, x, 0) for i in range(1, 8) for n, x in enumerate((0, 40, 100))] + [(8, 0, 5, 5)]
    refs = [(i, 1, 0.0) for i in range(1, 8)] + [(i, 2, 1.0) for i in (2, 3, 4, 5, 6, 7)] + [(1, 2, 0.9), (3, 9, 0.5), (4, 3, 0.2), (5, 3, 0.4), (5, 4, 0.4), (7, None, 0.3)]
    connectors = [(1, 0, 0), (2, 100, 0), (3, 40, 0), (4, 40, 0)]
    rules = [(6, "width", 0.0, 0.5, 1), (6, "width", 0.6, 1.0, 1), (7, "width", 0.0, 1.0, 1)]
    frames = [spark.createDataFrame(r, s) for r, s in ((vertices, "id long, seq long, x long, y long"), (refs, "id long, connector long, at double"), (connectors, "connector long, x long, y long"), (rules, "id long, layer string, lo double, hi double, value long"))]
    pieces, _, faults, _ = X.transport_graph(*frames, ["width"], 0.001)
    assert {tuple(r) for r in faults.collect()} == {(1, "ends"), (1, "off the line"), (3, "unknown"), (4, "off the line"), (5, "ambiguous"), (6, "width gap"), (8, "short"), (8, "ends")}
    assert {r.id for r in pieces.collect()} == {2, 7}


def test_structures(spark):
    """A row of bridges of one layer, each over the next: the first of each pair that fails goes, which frees the other."""
    ways, points = [], []
    for n in range(6):
        ways.append((n, n * 10, n * 10 + 1, 1, True, True, True, False, False))
        x = n * 150
        points += [(n, 1, n * 10, x, 0), (n, 2, n * 10 + 1, x + 300, 0)] if n % 2 else [(n, 1, n * 10, x, -150), (n, 2, n * 10 + 1, x, 150)]
    # a short tunnel under a footway only, a bridge with a road that meets it, and one that bends too much
    ways += [(20, 200, 201, -1, True, False, True, False, False), (21, 210, 211, 0, False, False, False, False, True)]
    points += [(20, 1, 200, 5000, 0), (20, 2, 201, 5040, 0), (21, 1, 210, 5020, -50), (21, 2, 211, 5020, 50)]
    ways += [(30, 300, 302, 1, True, True, True, False, False), (31, 301, 310, 0, False, False, False, False, False)]
    points += [(30, 1, 300, 7000, 0), (30, 2, 301, 7100, 0), (30, 3, 302, 7200, 0), (31, 1, 301, 7100, 0), (31, 2, 310, 7100, 90)]
    ways.append((40, 400, 402, 1, True, True, True, False, False))
    points += [(40, 1, 400, 9000, 0), (40, 2, 401, 9100, 0), (40, 3, 402, 9090, 100)]
    schema = "id long, a long, b long, layer long, structure boolean, bridge boolean, candidate boolean, level boolean, walking boolean"
    status, kept = T.estimate_structures(spark.createDataFrame(ways, schema), spark.createDataFrame(points, "id long, seq long, ref long, x long, y long"), 100)
    got = {r.chain: r.status for r in status.collect()}
    # way 1 runs from 150 to 450 and crosses 2 at 300; 3 from 450 to 750 crosses 4 at 600; 5 crosses none
    assert got == {0: "estimated", 1: "separation", 2: "estimated", 3: "separation", 4: "estimated", 5: "estimated", 20: "level", 30: "branched", 40: "shape"}
    assert {r.way for r in kept.collect()} == {0, 2, 4, 5}


def test_segments_are_dealt_once_for_their_faults(spark, capsys, monkeypatch):
    """Faults of vertices and references need one shuffle by segment, lines of ways one from their table on, and roads read what was swept; odd references keep their faults."""
    from geoloom.operators import graph as GR
    from geoloom.plans import transport_queries as Q

    made = []
    monkeypatch.setattr(X, "written", lambda df: made.append(df) or GR.written(df))
    monkeypatch.setattr(Q, "written", lambda df: made.append(df) or GR.written(df))

    def shuffles(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out.count("Exchange hashpartitioning")

    roads = Q._graph(spark, "/root/testdata/sf0.001")[1]
    assert len(made) == 3 and shuffles(made[0]) == 1 and shuffles(made[1]) <= 4 and shuffles(roads) <= 3
    vertices = spark.createDataFrame([(1, 0, 0, 0, 0.0), (1, 1, 9, 0, 1.0), (2, 0, 4, 4, None)], "id long, seq long, x long, y long, at double")
    refs = spark.createDataFrame([(1, 5, 0.0), (1, 6, 1.0), (1, 6, None), (3, 7, 0.5), (3, 8, 0.5)], "id long, connector long, at double")
    connectors = spark.createDataFrame([(5, 0, 0), (6, 9, 0), (8, 1, 1), (8, 2, 2)], "connector long, x long, y long")
    rules = spark.createDataFrame([], "id long, layer string, lo double, hi double, value long")
    faults = X.transport_graph(vertices, refs, connectors, rules, [], 0.001)[2]
    assert sorted(tuple(r) for r in faults.collect()) == [(1, "ambiguous"), (2, "ends"), (2, "short"), (3, "repeated"), (3, "unknown")]
