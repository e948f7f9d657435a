"""Joining of water levels against the serial run, with the rounds counted."""

import random

import pytest

from geoloom.operators.levels import join_levels

UNITS = "id long, low long, median long, high long, tight boolean"


def serial(units, edges, level_range, stretch_range):
    group = {u[0]: u[0] for u in units}
    state = {i: [low, None if tight else median, high if tight else None] for i, low, median, high, tight in units}
    low, tight = {u[0]: u[1] for u in units}, {u[0]: u[4] for u in units}
    most = lambda *v: max((x for x in v if x is not None), default=-(10**12))
    ordered = sorted({(abs(low[a] - low[b]), min(a, b), max(a, b)) for a, b in edges if a != b and a in group and b in group})
    for wide in (True, False):
        for _, a, b in ordered:
            if wide and (tight[a] or tight[b]) or group[a] == group[b]:
                continue
            x, y = state[group[a]], state[group[b]]
            level = min(x[0], y[0])
            if most(x[1], y[1]) - level <= level_range and most(x[2], y[2]) - level <= stretch_range:
                keep, lose = sorted((group[a], group[b]))
                state[keep] = [level, most(x[1], y[1]), most(x[2], y[2])]
                group = {i: keep if g == lose else g for i, g in group.items()}
    return {(i, g, state[g][0]) for i, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_serial_run(spark, seed):
    rng = random.Random(seed)
    units, edges = [], []
    for i in range(90):
        low = rng.randrange(0, 120)
        median = low + rng.randrange(0, 30)
        units.append((i, low, median, median + rng.randrange(0, 40), rng.random() < 0.3))
        edges += [(i, i + 1), (i + 10, i)] if rng.random() < 0.9 else []
    edges += [(3, 3), (4, 3), (500, 1)] + edges[:4]
    got, rounds = join_levels(spark.createDataFrame(units, UNITS), spark.createDataFrame(edges, "a long, b long"), 40, 70)
    want = serial(units, edges, 40, 70)
    assert {tuple(r) for r in got.collect()} == want and 1 < len({g for _, g, _ in want}) < 60
    assert rounds <= 25


def test_lakes_first_and_empty(spark):
    """A tight neighbour that is more similar waits until the lake's wide units have joined."""
    units = [(1, 100, 105, 105, False), (2, 90, 95, 95, False), (3, 99, 99, 140, True)]
    edges = [(1, 3), (1, 2)]
    got, _ = join_levels(spark.createDataFrame(units, UNITS), spark.createDataFrame(edges, "a long, b long"), 15, 45)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 90), (2, 1, 90), (3, 3, 99)} == serial(units, edges, 15, 45)
    none, rounds = join_levels(spark.createDataFrame([], UNITS), spark.createDataFrame([], "a long, b long"), 15, 45)
    assert none.isEmpty() and rounds == 0
