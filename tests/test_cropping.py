"""Polygons cut at a window against area and membership by other means, on a grid small enough for many ties."""

import math
import random

import pytest

from geoloom.operators.cropping import crop_polygons

EDGE = "id long, ring long, role string, seq long, n long, x long, y long, x2 long, y2 long"
WINDOW = (10, 12, 30, 26)


def edges_of(i, ring, role, points):
    return [(i, ring, role, k, len(points), *points[k], *points[(k + 1) % len(points)]) for k in range(len(points))]


def star(rng, cx, cy, reach):
    """A simple polygon: corners by strictly rising angle around a centre."""
    by_angle = {}
    for _ in range(rng.randint(4, 14)):
        x, y = cx + rng.randint(-reach, reach), cy + rng.randint(-reach, reach)
        if (x, y) != (cx, cy):
            by_angle.setdefault(math.atan2(y - cy, x - cx), (x, y))
    angles = sorted(by_angle)
    gaps = [(b - a) % (2 * math.pi) for a, b in zip(angles, angles[1:] + angles[:1])]
    return [by_angle[a] for a in angles] if len(angles) > 2 and max(gaps) < math.pi - 1e-9 else None


def half(points, axis, at, sign):
    """Points kept on one side of a line; what it adds along the line has no area."""
    out = []
    for p, q in zip(points[-1:] + points[:-1], points):
        a, b = sign * (p[axis] - at), sign * (q[axis] - at)
        if (a < 0) != (b < 0):
            t = a / (a - b)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if b >= 0:
            out.append(q)
    return out


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def clipped_area(points):
    for axis, at, sign in ((0, WINDOW[0], 1), (1, WINDOW[1], 1), (0, WINDOW[2], -1), (1, WINDOW[3], -1)):
        points = half(points, axis, at, sign)
    return abs(area(points)) if points else 0.0


def within(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def rings_of(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r.seq):
        found.setdefault(r.id, {}).setdefault(tuple(r.ring), []).append(r)
    for of_one in found.values():
        for ring in of_one.values():
            assert [r.seq for r in ring] == list(range(len(ring)))
    return {i: [[(r.x, r.y) for r in ring] for ring in of_one.values()] for i, of_one in found.items()}


def test_areas_and_points(spark):
    rng, shapes, rows = random.Random(1), {}, []
    while len(shapes) < 400:
        cx, cy = rng.randint(4, 36), rng.randint(6, 32)
        outer = star(rng, cx, cy, rng.choice((3, 6, 12, 20, 40)))
        if outer is None:
            continue
        rings = [outer]
        hole = star(rng, cx, cy, 2)
        if hole and rng.random() < 0.5 and all(within([outer], x + dx, y + dy) for x, y in hole for dx in (-1.5, 1.5) for dy in (-1.5, 1.5)) and clear(outer, hole):
            rings.append(hole)
        i = len(shapes)
        shapes[i] = rings
        for k, ring in enumerate(rings):
            rows += edges_of(i, k, "outer" if k == 0 else "inner", ring[::-1] if rng.random() < 0.5 else ring)
    kept, verdicts = crop_polygons(spark.createDataFrame(rows, EDGE), WINDOW)
    got, told = rings_of(kept.collect()), dict(verdicts.collect())
    assert set(told) == set(shapes) and "unsound" not in told.values()
    assert {"whole", "cut", "outside"} <= set(told.values())
    for i, rings in shapes.items():
        want = clipped_area(rings[0]) - sum(map(clipped_area, rings[1:]))
        mine = got.get(i, [])
        assert sum(map(area, mine)) == pytest.approx(want, abs=1e-6), (i, rings, told[i])
        assert (told[i] in ("whole", "cut")) == (want > 1e-9)
        assert all(WINDOW[0] <= x <= WINDOW[2] and WINDOW[1] <= y <= WINDOW[3] for ring in mine for x, y in ring)
        for ring in mine:
            assert len(ring) >= 3 and all(a != b for a, b in zip(ring, ring[1:] + ring[:1]))
        for _ in range(40):
            x, y = rng.uniform(WINDOW[0], WINDOW[2]), rng.uniform(WINDOW[1], WINDOW[3])
            assert within(mine, x, y) == within(rings, x, y)


def clear(outer, hole):
    """No edge of the hole meets one of the outer ring, by many points along it."""
    return all(within([outer], a[0] + t / 20 * (b[0] - a[0]), a[1] + t / 20 * (b[1] - a[1])) for a, b in zip(hole, hole[1:] + hole[:1]) for t in range(21))


def crop(spark, *shapes, window=WINDOW):
    rows = [e for i, rings in enumerate(shapes) for k, ring in enumerate(rings) for e in edges_of(i, k, "outer" if k == 0 else "inner", ring)]
    kept, verdicts = crop_polygons(spark.createDataFrame(rows, EDGE), window)
    return rings_of(kept.collect()), dict(verdicts.collect())


def test_named_cases(spark):
    around = [(0, 0), (60, 0), (60, 60), (0, 60)]
    hole = [(15, 15), (15, 20), (20, 20), (20, 15)]
    beside = [(0, 12), (10, 12), (10, 26), (0, 26)]
    at_corner = [(30, 26), (40, 26), (40, 40)]
    comb = [(5, 14), (35, 14), (35, 24), (5, 24), (5, 22), (32, 22), (32, 16), (5, 16)]
    touching = [(12, 14), (20, 26), (28, 14)]
    split = [(5, 13), (35, 13), (35, 20), (30, 20), (32, 22), (30, 24), (35, 24), (35, 40), (5, 40)]
    got, told = crop(spark, [around], [around, hole], [beside], [at_corner], [comb], [touching], [split], [[(100, 100), (110, 100), (110, 110)]])
    assert told == {0: "cut", 1: "cut", 2: "contact", 3: "contact", 4: "cut", 5: "whole", 6: "cut", 7: "outside"}
    assert got[0] == [[(10, 12), (30, 12), (30, 26), (10, 26)]]
    assert sorted(map(area, got[1])) == [-25, 280]
    assert sorted(map(area, got[4])) == [40, 40]  # two strips, not one with a bridge along the side
    assert sorted(got[5][0]) == sorted(touching) and area(got[5][0]) == -area(touching)
    assert sum(map(area, got[6])) == pytest.approx(20 * 13)


def test_a_long_ring_and_edges_of_input(spark):
    # teeth across the eastern side: more cuts than stretches, more edges than a chunk
    n = 5000
    teeth = [p for k in range(n) for p in ((900, 2 * k), (1100, 2 * k + 1))] + [(0, 2 * n), (0, -1)]
    window = (100, -10, 1000, 3 * n)
    got, told = crop(spark, [teeth], window=window)
    assert told == {0: "cut"} and len(got[0]) == 1
    assert area(got[0][0]) == pytest.approx(clip(teeth, window), rel=1e-9)
    none = spark.createDataFrame([], EDGE)
    kept, verdicts = crop_polygons(none, WINDOW)
    assert kept.count() == 0 and verdicts.count() == 0
    bad = edges_of(1, 0, "outer", [(0, 0), (20, 20), (40, 0)]) + [(2, 0, "outer", 0, 1, None, 3, 4, 5)]
    kept, verdicts = crop_polygons(spark.createDataFrame(bad, EDGE), WINDOW)
    assert dict(verdicts.collect())[2] == "unsound" and {r.id for r in kept.collect()} == {1}
    assert dict(crop_polygons(spark.createDataFrame(bad, EDGE), (5, 5, 5, 9))[1].collect()) == {1: "unsound", 2: "unsound"}
    crossing = edges_of(3, 0, "outer", [(0, 14), (20, 14), (20, 20), (0, 20)]) + edges_of(3, 1, "outer", [(0, 16), (25, 16), (25, 24), (0, 24)])
    kept, verdicts = crop_polygons(spark.createDataFrame(crossing, EDGE), WINDOW)
    assert dict(verdicts.collect()) == {3: "unsound"} and kept.count() == 0


def clip(points, window):
    for axis, at, sign in ((0, window[0], 1), (1, window[1], 1), (0, window[2], -1), (1, window[3], -1)):
        points = half(points, axis, at, sign)
    return abs(area(points))
