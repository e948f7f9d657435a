"""Polygons of relations and large polygons in cells, against brute force."""

import random

from geoloom.operators import graph as GR
from geoloom.operators import polygons as G
from geoloom.operators import spatial as P

MEMBERS = "relation long, pos int, type string, ref long, role string, tags map<string, string>"
WAYS = "id long, tags map<string, string>, kind string"


def in_ring(x, y, edges):
    """Even-odd rule; a point on an edge counts as inside."""
    inside = False
    for ax, ay, bx, by in edges:
        turn = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if turn == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (turn > 0) == (by > ay):
            inside = not inside
    return inside


def cut_ring(rng, nodes):
    """A ring's nodes cut into ways, each drawn in either direction."""
    n = len(nodes)
    cuts = sorted(rng.sample(range(n), rng.randint(2, min(9, n))))
    parts = []
    for a, b in zip(cuts, [*cuts[1:], cuts[0] + n]):
        part = [nodes[k % n] for k in range(a, b + 1)]
        parts.append(part if rng.random() < 0.5 else part[::-1])
    return parts


def canonical(nodes):
    k = nodes.index(min(nodes))
    forward = nodes[k:] + nodes[:k]
    return min(forward, [forward[0], *forward[:0:-1]])


def test_rings_of_cut_ways(spark):
    rng, members, lines, want, way = random.Random(3), [], [], {}, 0
    for group in range(12):
        for _ in range(rng.randint(1, 3)):
            nodes = [group * 1000 + x for x in rng.sample(range(1000), rng.randint(3, 60))]
            if any(set(nodes) & set(r) for r in want.get(group, [])):
                continue
            want.setdefault(group, []).append(canonical(nodes))
            parts = cut_ring(rng, nodes) if rng.random() < 0.8 else [[*nodes, nodes[0]]]
            for part in parts:
                members.append((group, way * 37 % 1009))
                lines += [(way * 37 % 1009, i + 1, n) for i, n in enumerate(part)]
                way += 1
    # faults: an end used once, an end used four times, a ring that meets itself, a ring of two nodes
    bad = {100: [[1, 2, 3], [3, 4]], 101: [[1, 2, 3], [3, 4, 1], [1, 5, 6], [6, 7, 1]], 102: [[1, 2, 3], [3, 2, 4, 1]], 103: [[1, 2], [2, 1]]}
    for group, parts in bad.items():
        for part in parts:
            members.append((group, 2000 + way))
            lines += [(2000 + way, i + 1, n) for i, n in enumerate(part)]
            way += 1
    rings, faults = G.ring_vertices(spark.createDataFrame(members, "group long, way long"), spark.createDataFrame(lines, "id long, seq int, ref long"))
    got = {}
    for r in rings.orderBy("group", "ring", "seq").collect():
        got.setdefault((r["group"], r["ring"]), []).append(r["node"])
    found = {}
    for (group, _), nodes in got.items():
        found.setdefault(group, []).append(nodes)
    assert {g: sorted(r) for g, r in found.items()} == {g: sorted(r) for g, r in want.items()}
    assert {(r["group"], r["fault"]) for r in faults.collect()} == {(100, "open"), (101, "open"), (102, "repeated node"), (103, "short")}


def test_one_long_ring(spark):
    """Three thousand ways of one relation in a dozen rounds, no group of which is one task."""
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    lines = [(order[i], s, (i + (s - 1 if i % 3 else 2 - s)) % n) for i in range(n) for s in (1, 2)]
    rings, faults = G.ring_vertices(spark.createDataFrame([(1, w) for w in order], "group long, way long"), spark.createDataFrame(lines, "id long, seq int, ref long"))
    assert [(r.seq, r.node) for r in rings.orderBy("seq").collect()] == [(i, i) for i in range(n)]
    assert faults.isEmpty()
    assert "Window" not in rings._jdf.queryExecution().optimizedPlan().toString()


def test_darts_of_cycles_find_one_of_them(spark):
    rng, links, place = random.Random(26), [], {}
    for c, n in enumerate([1, 2, 3, 31, 32, 33, 700]):
        darts, at = rng.sample(range(c * 1000, c * 1000 + 1000), n), 0
        for i, d in enumerate(darts):
            links.append((d, darts[(i + 1) % n], rng.randint(0, 9)))
            place[d] = (c, at)
            at += links[-1][2]
    whole = {c: sum(k for d, _, k in links if place[d][0] == c) for c, _ in place.values()}
    for rounds in (1, 5):  # one round a level takes many levels
        got = GR.cycle_lows(spark.createDataFrame(links, "dart long, next long, dist long"), rounds).collect()
        assert len(got) == len(links) and len({r.low for r in got}) == 7
        for r in got:
            (c, a), (low_c, b) = place[r.dart], place[r.low]
            assert c == low_c and (r.dist - (b - a)) % max(1, whole[c]) == 0 and 0 <= r.dist <= whole[c] and (r.dart != r.low or r.dist == 0)


def test_long_rings_are_not_written_whole_each_round(spark, monkeypatch):
    """What is written for a ring is some rows for each of its ways, not some for each round of each way."""
    n, rows, real = 2000, [], GR.written

    def counted(df):
        table = real(df)
        rows.append(table.count())
        return table

    monkeypatch.setattr(GR, "written", counted)
    monkeypatch.setattr(G, "written", counted)
    ways = [(1, i * 7919 % 10007, i, (i + 1) % n, 1) for i in range(n)]
    order, _ = G.ring_order(spark.createDataFrame(ways, "group long, way long, a long, b long, size long"))
    assert {(r.way, r.offset) for r in order.collect()} == {(i * 7919 % 10007, i) for i in range(n)} and sum(rows) < 25 * n


def square(node, x, y, half, way):
    corners = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
    nodes = [(node + i, cx, cy) for i, (cx, cy) in enumerate(corners)]
    return nodes, [(way, i + 1, node + i % 4) for i in range(5)]


def relation(spark, *rings, tags=None):
    nodes, lines, members, ways = [], [], [], []
    for k, (rel, role, x, y, half) in enumerate(rings):
        n, way_nodes = square(k * 10, x, y, half, k)
        nodes += n
        lines += way_nodes
        members.append((rel, k, "way", k, role, {"landuse": "forest"}))
        ways.append((k, (tags or {}).get(k, {}), None))
    frames = spark.createDataFrame(members, MEMBERS), spark.createDataFrame(ways, WAYS), spark.createDataFrame(lines, "id long, seq int, ref long"), spark.createDataFrame(nodes, "id long, x long, y long")
    return frames


def faults_of(spark, *rings, **more):
    polygons, faults, used = G.relation_polygons(*relation(spark, *rings, **more), cell=10)
    return {(r.relation, r.ring, r.parent) for r in polygons.collect()}, {(r.relation, r.fault) for r in faults.collect()}, {(r.way, r.relation) for r in used.collect()}


def test_holes_islands_and_faults(spark):
    rings = [
        (1, "outer", 0, 0, 100), (1, "inner", 10, 0, 50), (1, "outer", 10, 0, 20), (1, "inner", 10, 0, 5), (1, "outer", 500, 0, 30),
        (2, "outer", 0, 0, 90), (2, "inner", 0, 0, 20),  # lies over relation 1, which is no fault
        (3, "outer", 0, 0, 50), (3, "outer", 0, 0, 20),
        (4, "outer", 0, 0, 50), (4, "inner", 200, 0, 20),
        (5, "outer", 0, 0, 50), (5, "inner", 40, 0, 20),
        (6, "inner", 0, 0, 50),
        (7, "outer", 0, 0, 50), (7, "inner", 0, 0, 30), (7, "inner", 0, 0, 10),
        (8, "outer", 0, 0, 50), (8, "inner", 30, 0, 20),
        (9, "outer", 0, 0, 0),
        (10, "outer", 0, 0, 50), (11, "outer", 0, 0, 50), (12, "part", 0, 0, 50),
    ]
    placed, faults, used = faults_of(spark, *rings, tags={20: {"landuse": "grass"}, 21: {"landuse": "forest"}})
    assert faults == {(3, "outer areas overlap"), (4, "hole outside"), (5, "rings meet"), (6, "no outer ring"), (6, "hole outside"), (7, "hole outside"), (8, "rings meet"), (9, "no area"), (9, "rings meet"), (10, "conflicting tags"), (12, "member kind")}
    assert placed == {(1, 0, None), (1, 1, 0), (1, 2, None), (1, 3, 2), (1, 4, None), (2, 5, None), (2, 6, 5), (11, 21, None)}
    assert used == {(w, 1) for w in range(5)} | {(5, 2), (6, 2), (21, 11)}


def test_members_once(spark):
    members, ways, lines, nodes = relation(spark, (1, "outer", 0, 0, 50), (2, "outer", 200, 0, 50), (3, "outer", 400, 0, 50))
    extra = spark.createDataFrame([(2, 9, "way", 0, "outer", {}), (3, 9, "way", 2, "outer", {}), (4, 0, "way", 77, "outer", {}), (5, 0, "node", 3, "outer", {}), (6, 0, "way", 1, None, None)], MEMBERS)
    _, faults, used = G.relation_polygons(members.unionByName(extra), ways, lines, nodes, 10, blocked=spark.createDataFrame([(1,)], "id long"))
    got = {(r.relation, r.fault) for r in faults.collect()}
    assert {(2, "shared member"), (2, "blocked member"), (3, "repeated member"), (4, "missing way"), (5, "member kind"), (6, "member kind"), (6, "shared member")} <= got
    assert {(r.way, r.relation) for r in used.collect()} == {(0, 1)}
    _, faults, _ = G.relation_polygons(members, ways, lines, nodes.where("id <> 11"), 10)
    assert {(r.relation, r.fault) for r in faults.collect()} == {(2, "missing node")}
    empty = [f.limit(0) for f in (members, ways, lines, nodes)]
    assert all(f.isEmpty() for f in G.relation_polygons(*empty, 10))


def test_large_polygons_in_large_cells(spark):
    rng = random.Random(7)
    polygons = {}
    for p, size in enumerate((20, 900, 7000, 7000, 100_000)):
        cx, cy = rng.randrange(0, 3000), rng.randrange(0, 3000)
        n = rng.randint(5, 30)
        import math

        corners = [(cx + int(size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n)), cy + int(size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n))) for k in range(n)]
        polygons[p] = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    polygons[2] += [(x + 40, y, x2 + 40, y2) for x, y, x2, y2 in polygons[0]]  # a hole
    points = [(i, rng.randrange(-9000, 9000), rng.randrange(-9000, 9000)) for i in range(400)] + [(1000 + i, *polygons[p][i % 5][:2]) for i, p in enumerate((0, 1, 2, 3, 4))]
    edges = spark.createDataFrame([(p, *e) for p, es in polygons.items() for e in es], "id long, x long, y long, x2 long, y2 long")
    got = {tuple(r) for r in P.points_in_polygons(spark.createDataFrame(points, "id long, x long, y long"), edges, 50).collect()}
    assert got == {(i, p) for i, x, y in points for p, es in polygons.items() if in_ring(x, y, es)}
    rows = P.points_in_polygons(spark.createDataFrame(points, "id long, x long, y long"), edges, 50)
    assert rows.count() == len(got)


def test_cells_along_segments(spark):
    rng = random.Random(2)
    segs = [(i, 0, *(rng.randrange(-300, 300) for _ in range(4))) for i in range(60)] + [(90, 0, -5000, -5000, 5000, 4999), (91, 0, -4000, 4000, 4000, -4000), (92, 0, 7, -900, 7, 900), (93, 0, 40, 40, 40, 40), (94, 0, -700, 50, 700, 50)]
    df = spark.createDataFrame(segs, "id long, seq int, x long, y long, x2 long, y2 long")
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    want = set()
    for s in segs:
        for t in segs:
            a, b, c, d = s[2:4], s[4:6], t[2:4], t[4:6]
            if s[0] < t[0] and turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                want.add((s[0], t[0]))
    got = P.crossings(df, 50).collect()
    assert {(r.a_id, r.b_id) for r in got} == want and len(got) == len(want)
    from pyspark.sql import functions as F

    assert P.segment_cells(df.where("id = 90"), F.lit(50)).count() < 500  # its box has 40,000


def test_region_of_boundaries(spark):
    members, _, lines, nodes = relation(spark, (1, "", 0, 0, 100), (1, "inner", 0, 0, 20), (2, "outer", 300, 0, 50), (3, "outer", 900, 0, 50), (4, "label", 0, 0, 5), (5, "outer", 0, 700, 50))
    lines = lines.where("NOT (id = 3 AND seq = 5) AND id <> 5")
    edges, faults = G.boundary_edges(members, lines, nodes)
    points = spark.createDataFrame([(1, 50, 0), (2, 0, 0), (3, 20, 0), (4, 300, 50), (5, 900, 0), (6, 0, 700)], "id long, x long, y long")
    assert {r.id for r in G.in_region(points, edges, 10).collect()} == {1, 3, 4}
    assert {tuple(r) for r in faults.collect()} == {(3, "open"), (5, "incomplete")}
