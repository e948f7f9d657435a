"""The closure over shared nodes against a serial walk, and how often it reads its incidence."""

import random

from pyspark.sql import functions as F

from geoloom.operators import graph as GR


def serial(seeds, inc, inner):
    hops, front, hop = dict.fromkeys(seeds, 0), set(seeds), 0
    while front:
        hop += 1
        nodes = {n for w, n in inc if w in front and w in inner and n is not None}
        front = {w for w, n in inc if n in nodes} - set(hops)
        hops |= dict.fromkeys(front, hop)
    return hops


def test_random_ways(spark):
    rng = random.Random(20)
    inc = [(w, rng.choice([None, *range(220)])) for w in range(300) for _ in range(rng.randint(1, 3))] * 2
    seeds, inner = {1, 2, 150, 999}, {w for w in range(0, 300) if w % 3} | {2000}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = GR.closure(table([(w,) for w in seeds for _ in range(2)], "way long"), table(inc, "way long, node long"), table([(w,) for w in inner], "way long")).collect()
    want = serial(seeds, inc, inner)
    assert {r.way: r.hop for r in got} == want and len(got) == len(want) and max(want.values()) > 4
    none = GR.closure(table([], "way long"), table(inc, "way long, node long"), table([(1,)], "way long"))
    assert none.isEmpty() and none.columns == ["way", "hop"]


def test_long_walks_read_the_incidence_twice(spark):
    """A chain of 18 ways takes 18 rounds (more than are put together at once), none of which goes over the whole incidence."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x

    inc = spark.range(18).select(F.col("id").alias("way"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("node"))
    inc = inc.select("way", seen.asNondeterministic()("node").alias("node"))
    got = GR.closure(spark.range(1).select(F.col("id").alias("way")), inc, spark.range(18).select(F.col("id").alias("way"))).collect()
    assert {tuple(r) for r in got} == {(w, w) for w in range(18)}
    assert read.value <= 2 * 36
