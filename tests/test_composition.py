"""Fusion against a serial run, runs for changed cells alone against whole ones, and roads against footprints."""

import math
import random
import statistics

from pyspark.sql import functions as F

from geoloom.operators import composition as K

CELL = 4000
BASE = "id long, x0 long, y0 long, x1 long, y1 long, h double, source string"
AUX = "id long, x0 long, y0 long, x1 long, y1 long, h double, floors long, kind string, underground boolean, source string"
SEGS = "road long, seq long, x long, y long, x2 long, y2 long, z double, z2 double, width long, kind string"


def box(rng):
    x, y = rng.randrange(0, 60_000), rng.randrange(0, 20_000)
    return x, y, x + rng.randrange(300, 1800), y + rng.randrange(300, 1800)


def rows(seed, n_base=60, n_aux=120):
    rng = random.Random(seed)
    base = [(i, *box(rng), rng.choice([None, 5.0, 9.0, 20.0]), rng.choice([None, f"s{rng.randrange(60)}"])) for i in range(n_base)]
    aux = [(i, *box(rng), rng.choice([None, None, 0.0, 7.0]), rng.choice([None, None, 0, 4]), rng.choice(["house", "shed", "odd"]), rng.random() < 0.05, rng.choice([None, f"s{rng.randrange(200)}"])) for i in range(n_aux)]
    aux += [(200 + i, *b[1:5], None, None, "house", None, None) for i, b in enumerate(base[:5])]
    segs = []
    for road in range(12):
        x, y = rng.randrange(0, 60_000), rng.randrange(0, 20_000)
        for seq in range(4):
            x2, y2 = x + rng.randrange(-3000, 3000), y + rng.randrange(-3000, 3000)
            segs.append((road, seq, x, y, x2, y2, float(rng.randrange(-9, 12)), float(rng.randrange(-9, 12)), rng.choice([300, 800]), ["ground", "bridge", "tunnel"][road % 3]))
            x, y = x2, y2
    return base, aux, segs, [("house", 6.0), ("shed", 3.0)]


def frames(spark, base, aux, segs, profiles):
    return K.Sources(spark.createDataFrame(base, BASE), spark.createDataFrame(aux, AUX), spark.createDataFrame(segs, SEGS), spark.createDataFrame(profiles, "kind string, height double"))


def near(p, a, b):
    """Distance of a point from a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def clip(a, b, x0, y0, x1, y1):
    t0, t1 = 0.0, 1.0
    for p, q, low, high in ((a[0], b[0], x0, x1), (a[1], b[1], y0, y1)):
        if p == q:
            if not low <= p <= high:
                return None
            continue
        u, v = sorted(((low - p) / (q - p), (high - p) / (q - p)))
        t0, t1 = max(t0, u), min(t1, v)
    return (t0, t1) if t0 <= t1 else None


def cuts(rect, base, top, segs):
    """Pieces that cut a footprint, road by road."""
    over, bad = [], set()
    x0, y0, x1, y1 = rect
    for road, seq, x, y, x2, y2, z, z2, width, kind in segs:
        a, b = (x, y), (x2, y2)
        gap = 0 if clip(a, b, *rect) else min(*(near(c, a, b) for c in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))), *(math.hypot(max(x0 - p, 0, p - x1), max(y0 - q, 0, q - y1)) for p, q in (a, b)))
        if gap >= width / 2:
            continue
        t = clip(a, b, x0 - width / 2, y0 - width / 2, x1 + width / 2, y1 + width / 2) or (0, 1)
        heights = [z + (z2 - z) * k for k in t]
        over.append((road, seq))
        if not (kind == "bridge" and min(heights) >= top + 0.5 or kind == "tunnel" and max(heights) + 0.5 <= base):
            bad.add(road)
    return {(r, s) for r, s in over if r in bad}


def common(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0


def serial(base, aux, segs, profiles):
    out, added, area = {}, [], lambda r: (r[2] - r[0]) * (r[3] - r[1])
    middle = lambda r: ((r[0] + r[2]) // 2, (r[1] + r[3]) // 2)
    for i, *rect, h, floors, kind, under, source in sorted(aux, key=lambda r: r[0]):
        met = [common(rect, b[1:5]) / (area(rect) + area(b[1:5]) - common(rect, b[1:5])) for b in base if common(rect, b[1:5])]
        if under:
            out[i] = "underground", None, None
        elif source is not None and source in {b[6] for b in base}:
            out[i] = "duplicate id", None, None
        elif met:
            out[i] = ("duplicate overlap" if max(met) >= 0.5 else "conflict"), None, None
        else:
            around = [b[5] for b in base if b[5] is not None and math.dist(middle(rect), middle(b[1:5])) <= 6000]
            own = [(h, "auxiliary:height"), ((floors or 0) * 3.0, "auxiliary:floors"), (statistics.median(around) if len(around) >= 3 else None, "context:neighbour_median")]
            height, basis = next(((v, n) for v, n in own if v), (dict(profiles).get(kind), "context:profile"))
            if any(common(rect, r) for r in added):
                out[i] = "conflict", None, None
            elif cuts(rect, 0.0, height or 0.0, segs):
                out[i] = "road conflict", None, None
            else:
                added.append(rect)
                out[i] = "added", height, basis
    return out


def result(df):
    got = [tuple(r) for r in df.select("id", "verdict", "height", "basis").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_fusion_equals_a_serial_run_and_changes_alone_do(spark):
    base, aux, segs, profiles = rows(1)
    whole = K.fuse_sources(frames(spark, base, aux, segs, profiles), CELL)
    want = serial(base, aux, segs, profiles)
    assert result(whole) == want
    assert {v[0] for v in want.values()} == {"underground", "duplicate id", "duplicate overlap", "conflict", "road conflict", "added"}
    kept = spark.createDataFrame([(i, *v) for i, v in want.items()], "id long, verdict string, height double, basis string")
    before = K.signatures(frames(spark, base, aux, segs, profiles), CELL)

    # one footprint moves, one goes, one comes; a base record gets another source id
    moved = [(r[0], r[1] + 700, r[2], r[3] + 700, *r[4:]) if r[0] == 17 else r for r in aux if r[0] != 40] + [(300, *aux[40][1:5], 8.0, None, "shed", False, None)]
    other = [(*b[:6], "s7") if b[0] == 3 else b for b in base]
    now = frames(spark, other, moved, segs, profiles)
    found, again = K.refuse_changed(now, K.changed_cells(before, K.signatures(now, CELL)), kept, CELL)
    assert result(found) == serial(other, moved, segs, profiles)
    assert 0 < again.count() < len(moved) - 20 and again.distinct().count() == again.count()


def test_a_profile_is_a_remote_dependency_and_no_change_judges_nothing(spark):
    base, aux, segs, profiles = rows(2, 20, 40)
    s = frames(spark, base, aux, segs, profiles)
    want = serial(base, aux, segs, profiles)
    kept = spark.createDataFrame([(i, *v) for i, v in want.items()], "id long, verdict string, height double, basis string")
    before = K.signatures(s, CELL)
    assert K.changed_cells(before, K.signatures(s, CELL)).isEmpty()
    more = frames(spark, base, aux, segs, [("house", 6.0), ("shed", 4.0)])
    found, again = K.refuse_changed(more, K.changed_cells(before, K.signatures(more, CELL)), kept, CELL)
    assert result(found) == serial(base, aux, segs, [("house", 6.0), ("shed", 4.0)])
    assert {r[0] for r in aux if r[7] == "shed"} <= {r.id for r in again.collect()}


def test_roads_are_all_or_nothing(spark):
    house = spark.createDataFrame([(1, 0, 0, 1000, 1000, 0.0, 6.0), (2, 0, 0, 1000, 1000, 0.0, 2.0), (3, 9000, 0, 9500, 500, 0.0, 3.0)], "id long, x0 long, y0 long, x1 long, y1 long, base double, top double")
    # two bridges over the footprint: one sinks at its end, one stays above; a tunnel below; a road beside
    segs = [(1, 0, -2000, 100, 500, 900, 8.0, 8.0, 300, "bridge"), (1, 1, 500, 900, 1500, 1200, 8.0, 3.0, 300, "bridge"), (2, 0, -2000, 300, 2000, 700, 8.0, 8.0, 300, "bridge"), (3, 0, 0, -900, 900, 1900, -1.0, -2.0, 300, "tunnel"), (4, 0, -500, -300, 1300, -160, 0.0, 0.0, 300, "ground"), (5, 0, -500, -300, 1300, -149, 0.0, 0.0, 300, "ground")]
    got = {tuple(r) for r in K.road_conflicts(house, spark.createDataFrame(segs, SEGS), 700).collect()}
    want = {(i, *c) for i, *rect, base, top in [(r[0], *r[1:5], r[5], r[6]) for r in house.collect()] for c in cuts(rect, base, top, segs)}
    assert got == want and {(1, 1, 0), (1, 1, 1)} <= got and not {r for r in got if r[1] in (2, 3)}
    assert K.road_conflicts(house, spark.createDataFrame(segs, SEGS).limit(0), 700).isEmpty()


def test_random_roads(spark):
    rng = random.Random(9)
    houses = [(i, *box(rng), float(rng.randrange(-4, 3)), float(rng.randrange(4, 12))) for i in range(80)]
    segs = rows(5)[2] + [(50, i, *(rng.randrange(0, 40_000), rng.randrange(0, 20_000)) * 2, 1.0, 1.0, 500, "ground") for i in range(5)]
    df = spark.createDataFrame(houses, "id long, x0 long, y0 long, x1 long, y1 long, base double, top double").withColumn("width", F.lit(1))
    got = {tuple(r) for r in K.road_conflicts(df, spark.createDataFrame(segs, SEGS), 2000).collect()}
    assert got == {(i, *c) for i, *rect, base, top in houses for c in cuts(rect, base, top, segs)} != set()
