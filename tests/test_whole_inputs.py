"""Queries without a filter on their inputs, against brute force on the smallest tables."""

import numpy as np

from geoloom.operators import sequences as S
from geoloom.plans import catalog
from geoloom.plans.base import near_lines, way_nodes

SF = "/root/testdata/sf0.001"


def test_crossings_of_all_segments(spark):
    segs = S.segments(near_lines(spark, SF)).select("id", "seq", "x", "y", "x2", "y2").collect()
    nodes = [(r.id, r.ref) for r in way_nodes(spark, SF).collect()]
    assert len(segs) == len(nodes) - len({i for i, _ in nodes})
    way, seq, x, y, x2, y2 = np.array(segs, np.int64).T

    def turn(a, b):  # on which side of segment a each end of segment b lies
        return [np.sign((x2[a] - x[a]) * (v[b] - y[a]) - (y2[a] - y[a]) * (u[b] - x[a])) for u, v in ((x, y), (x2, y2))]

    want, everyone = set(), np.arange(len(segs))
    for i in everyone:
        (p, q), (r, s) = turn(i, everyone), turn(everyone, i)
        for j in np.flatnonzero((p * q < 0) & (r * s < 0) & (way > way[i])):
            want.add((way[i], seq[i], way[j], seq[j]))
    got = catalog.QUERIES["jon20_crossings"](spark, SF).collect()
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want
    refs = {}
    for i, ref in nodes:
        refs.setdefault(i, set()).add(ref)
    pairs = {(a, b) for a, _, b, _ in want if not refs[a] & refs[b]}
    found = catalog.QUERIES["jon21_unshared_crossings"](spark, SF).collect()
    assert len(found) == len(pairs) and {tuple(r) for r in found} == pairs


def test_whole_rasters_and_graphs(spark):
    run = lambda name: catalog.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert n > 64 and run("win12_opening").count() == run("sca18_quantised").count() == 64 * n
    edges = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for key, customer in edges:
        a, b = sorted((root(customer * 2), root(key // 37 * 2 + 1)))
        up[b] = a
    assert {(r.node, r.component) for r in run("gra02_components").collect()} == {(v, root(v)) for v in list(up)}
    assert run("pip14_quality_report").first().edges == len(edges)
