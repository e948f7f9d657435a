"""Line dedup, periodic runs and heap-ordered clusters, against brute force and on the awkward cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from geoloom.llm import heap_clusters, line_dedup, periodic, queries
from geoloom.llm.text import mix

BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, id string, h long, n long, runs string, kept string, batch int"


def line_rows():
    rng = random.Random(4)
    common = ["Share this", "  share THIS\t", "all rights reserved 2020", "é", "\x0b", "", "É"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own {rng.randrange(60)}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, "share this\nx"), (None, "share this"), (7, rows[7][1]), (7, rows[7][1]), (103, "y\n" * 3000 + "share this\r\n" * 3000)]
    return rows


def brute_lines(rows, least, min_chars=1):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = {}
    for at, (_, text) in enumerate(rows):
        for line in (text or "").encode().split(b"\n"):
            held.setdefault(key(line), set()).add(at)
    gone = {k for k, v in held.items() if len(v) >= least and len(k.decode()) >= min_chars and k}
    out = []
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        left = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(left), b"\n".join(left).decode()))
    return sorted(out, key=repr)


def with_more(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "r", "k", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("most", "batches", "fanout"), [(1 << 20, 4, 2), (0, 4, 2), (1 << 20, 5, 3), (1 << 20, 1, 2)])
def test_line_dedup(spark, most, batches, fanout):
    rows = line_rows()
    got = line_dedup.line_dedup(with_more(spark, rows), least=10, batches=batches, fanout=fanout, most_broadcast=most, chunk=100).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 10)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_short_keys_stay(spark):
    rows = line_rows()
    got = line_dedup.line_dedup(with_more(spark, rows), least=5, min_chars=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 5, 2)
    assert line_dedup.line_dedup(with_more(spark, rows).limit(0)).count() == 0


def test_runs_know_what_is_common(spark):
    """A key settled by one batch is left out of the next, and levels hold less than ``fanout`` runs each."""
    runs = line_dedup.Runs(spark, least=3, buckets=2)
    batch = lambda *rows: spark.createDataFrame(list(rows), "h long, g long, n long")
    runs.add(batch((1, 1, 3), (2, 2, 1), (1, 5, 1)))
    runs.add(batch((1, 1, 9), (2, 2, 1), (1, 5, 1)))
    (merged,) = runs.tables()
    assert sorted(map(tuple, spark.table(merged).collect())) == [(1, 1, 3), (1, 5, 2), (2, 2, 2)]
    for _ in range(3):
        runs.add(batch((2, 2, 1), (2, 2, 1)))
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted(map(tuple, runs.common().collect())) == [(1, 1), (2, 2)]


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words)):
        i = q
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first >= max(q, least - q):
                found.setdefault((first - q, i - first + q), q)
            i += 1
    return sorted((s, m, q) for (s, m), q in found.items())


def sequences():
    rng = random.Random(3)
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    thue = [0]
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    defect = ([0, 0, 1] * 9 + [0, 0] + [0, 0, 1] * 9) * 2
    out = [b, thue, defect, [0] * 400, [0] * 200 + [1] + [0] * 200, [0] * 11, [0] * 12, [0, 1] * 6, list(range(12)) * 2, list(range(12)) * 2 + [12], []]
    for _ in range(150):
        kinds, seq = rng.choice([1, 2, 2, 3, 40]), []
        while len(seq) < 250:
            part = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 5, 13, 25, 40]))]
            seq += (part * rng.randrange(1, 9))[: rng.randrange(1, 120)]
            if rng.random() < 0.3:
                seq += seq[-rng.randrange(1, len(seq) + 1) :]
        out.append(seq[:700])
    return out


def test_diagonals_find_all_runs():
    code = mix(np.arange(1, 100, dtype=np.uint64))
    seqs = sequences()
    together = periodic.Diagonals(np.concatenate([code[np.array(s, int)] for s in seqs]), np.repeat(np.arange(len(seqs)), [len(s) for s in seqs]), 12)
    together.find()
    got, at, want = sorted(zip(together.start.tolist(), together.length.tolist(), together.period.tolist())), 0, []
    for s in seqs:
        want += [(x + at, m, q) for x, m, q in brute_runs(s)]
        at += len(s)
    assert got == sorted(want) and len(want) > 500


def test_one_word_a_million_times_is_quick():
    found = periodic.Diagonals(np.full(1_000_000, 7, np.uint64), np.zeros(1_000_000, np.int64), 12)
    found.find()
    assert (found.start.tolist(), found.length.tolist(), found.period.tolist()) == ([0], [1_000_000], [1])


def test_periodic_runs(spark):
    texts = [" ".join(f"w{x}" for x in s) for s in sequences()[:40]] + [None, "", "  \n", "a b c", "é x " * 20, "x\ty\x0bz " * 7 + "end", "Ab aB " * 8]
    rows = [(i % 30 if i % 7 else None, t) for i, t in enumerate(texts)]
    got = periodic.periodic_runs(with_more(spark, rows)).collect()
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((i, len(words), sorted((s, m, q) for s, m, q in runs), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    flat = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got]
    assert sorted(flat, key=repr) == sorted(want, key=repr)
    assert [(x[0], x[2]) for x in flat if x[3] == "Ab aB"] == [(x[0], [(0, 16, 2)]) for x in flat if x[3] == "Ab aB"] != []
    assert periodic.digests(periodic.periodic_runs(with_more(spark, rows).limit(0))).count() == 0


def test_run_digests_and_planted_runs(spark):
    import zlib

    rows = [(i, None if i == 10 else " ".join(f"w{(i * k * k) % 17}" for k in range(i % 90))) for i in range(300)]
    got = {r.doc_id: r for r in periodic.digests(periodic.periodic_runs(queries.with_planted_runs(with_more(spark, rows)))).collect()}
    assert len(got) == 300
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        r = got[i]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(middle)), key=lambda c: (far(v, middle[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(middle)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted([(i, nearest(v), far(v, middle[nearest(v)])) for i, v in kept], key=repr), middle


def vector_rows(dims, n=400):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, dims))
    rows = [(i, (centres[i % 5] + rng.normal(size=dims) * 0.2).tolist()) for i in range(n)]
    rows += [(n + i, [float(i % 2)] * dims) for i in range(60)]  # ties and equal vectors
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (900, None), (901, [1.0] * (dims - 1)), (902, [None] + [1.0] * (dims - 1)), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (905, []), (906, [1e-9] * dims), (907, [-1e-9] * dims)]
    return rows


@pytest.mark.parametrize(("k", "rounds", "dims"), [(16, 3, 64), (7, 12, 3), (1, 2, 3), (16, 0, 3), (3, 3, 1)])
def test_clusters(spark, k, rounds, dims):
    rows = vector_rows(dims)
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int, distance int").repartition(3)
    got, middle = heap_clusters.cluster(df, k=k, rounds=rounds, dims=dims)
    want, centroids = brute_clusters(rows, k, rounds, dims)
    assert middle == centroids
    assert sorted(map(tuple, got.collect()), key=repr) == want
    named = heap_clusters.with_inertia(got, middle).collect()
    assert {r.inertia for r in named} == {sum(x[2] for x in want)}
    assert all(r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest() for r in named)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), -0.5]) for i in range(3)], "vec_id long, embedding array<float>")
    got, middle = heap_clusters.cluster(df, dims=2)
    assert len(middle) == 3 and [r.distance for r in got.collect()] == [0, 0, 0]
    none, middle = heap_clusters.cluster(df.limit(0), dims=2)
    assert middle == [] and heap_clusters.with_inertia(none, middle).count() == 0
    assert heap_clusters.with_inertia(none, middle).columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    big = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="beyond"):
        heap_clusters.cluster(big, dims=2)


def test_only_expired_vectors_are_compared_again():
    """Far groups keep their cluster without a new comparison, and a heap survives packing."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 50, (500, 4)), rng.integers(10_000, 10_050, (500, 4))])
    middle = np.array([[0, 0, 0, 0], [10_000] * 4])
    block = heap_clusters.Block(points, 2)
    block.assign(np.arange(1000), middle, np.zeros(2))
    block = heap_clusters.Block.unpacked(block.packed(), 4)
    assert len(block.expired(np.full(2, 100.0))) == 0
    drift = np.array([30_000.0, 30_000.0])
    assert len(block.expired(drift)) == 1000 and block.heaps == [[], []]
