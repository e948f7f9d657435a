"""Points kept apart by direction against the serial run."""

import random

from geoloom.operators.fusion import greedy_apart


def test_direction_and_kind(spark):
    rng = random.Random(5)
    ways = [(5, 0), (4, 3), (0, 5), (-5, 0), (None, None)]
    rows = [(i, rng.randint(0, 300), rng.randint(0, 300), *rng.choice(ways), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x long, y long, hx int, hy int, kind string")
    kept = []
    for i, x, y, hx, hy, kind in rows:
        blocked = any(k == kind and (x - a) ** 2 + (y - b) ** 2 <= 1600 and None not in (hx, ex) and hx * ex + hy * ey >= 20 for _, a, b, ex, ey, k in kept)
        if not blocked:
            kept.append((i, x, y, hx, hy, kind))
    got = {r.id for r in greedy_apart(df, 40, ["id"], ("hx", "hy"), 20, "kind").collect()}
    assert got == {r[0] for r in kept} and 100 < len(got) < 300
    assert greedy_apart(df.limit(0), 40, ["id"], ("hx", "hy"), 20).count() == 0
