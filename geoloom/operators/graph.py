"""Connected components and other iterative graph operators over edge tables."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.spatial import MADE, grown

#: Bytes of a table's packed files up to which it may be broadcast.
SMALL = 1 << 20

#: Most neighbours that a route's list holds.
LIST = 1024


def _shared(df: DataFrame) -> str:
    """The folder that driver and executors share: that of the session's checkpoints."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-geoloom-"))
    return sc.getCheckpointDir()


def _kept(df: DataFrame) -> DataFrame:
    _shared(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it has statistics, so small sides are broadcast,
    and no constraints, which double with each round of a loop that joins a table with itself. Files are packed, so
    a table of over ``SMALL`` bytes of them is never sent whole through the driver."""
    path, table = _stored(df)
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return table if at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength() <= SMALL else grown(table)


def stored(df: DataFrame) -> DataFrame:
    """As ``written``, for a table that may be large but is joined with ``written`` tables alone: how these are joined is left to their size.
    A large table's hint would sort and merge by keys that few rows have, so that all rows of one key were one task's."""
    return _stored(df)[1]


def _stored(df: DataFrame) -> tuple[str, DataFrame]:
    path = f"{_shared(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for every node of an edge.

    Each round every node takes the smallest label among its neighbours, then the label of its
    label, so long chains shrink by half or more. Labels are kept by checkpoint(), so a join's
    sides are plain scans: a node or component with very many rows is a skewed join that adaptive
    execution splits. Edges with a null end are left out; loops make their node a component.
    """
    plain = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = _kept(plain.union(plain.select("v", "u")).distinct())
    labels = _kept(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")))
    while True:
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("low"))
        hooked = _kept(labels.join(near, labels.node == near.v, "left").select("node", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")))
        if hooked.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        up = hooked.select(F.col("node").alias("at"), F.col("label").alias("above"))
        labels = _kept(hooked.join(up, hooked.label == up.at, "left").select("node", F.least("label", "above").alias("label")))


def closure(seeds: DataFrame, incidence: DataFrame, expandable: DataFrame) -> DataFrame:
    """(way, hop): ways reached from seed ways over shared nodes.

    incidence is (way, node). Only expandable ways are walked through; others are reached, not left, so rounds go over the expandable
    ways' incidence alone: each joins the newest ways to nodes not met before and these to new ways, and ends when none is new.
    All other ways take their hop from their nodes, in one pass over the whole incidence at the end.
    """
    first = grown(written(seeds.select("way").distinct()))
    known = grown(expandable.select(F.col("way").alias("_inner")))
    inner = grown(written(incidence.join(known, F.col("way") == F.col("_inner"), "left_semi").select("way", "node")))
    front = grown(written(first.join(known, F.col("way") == F.col("_inner"), "left_semi")))
    walked, met, hop = [front], [], 0
    while True:
        step = inner.join(front.select(F.col("way").alias("_at")), F.col("way") == F.col("_at"), "left_semi").select(F.col("node").alias("at")).where("at IS NOT NULL").distinct()
        if met:
            step = step.join(grown(reduce(DataFrame.unionByName, met).select(F.col("at").alias("_old"))), F.col("at") == F.col("_old"), "left_anti")
        nodes = grown(written(step.withColumn("hop", F.lit(hop))))
        if nodes.isEmpty():
            break
        near = inner.join(nodes, F.col("node") == F.col("at"), "left_semi").select("way").distinct()
        front = grown(written(near.join(grown(reduce(DataFrame.unionByName, walked).select(F.col("way").alias("_old"))), F.col("way") == F.col("_old"), "left_anti")))
        met, walked, hop = _joined(met, nodes), _joined(walked, front), hop + 1
    rounds = [first.withColumn("hop", F.lit(0))]
    if met:
        rounds.append(incidence.join(grown(reduce(DataFrame.unionByName, met)), F.col("node") == F.col("at")).select("way", (F.col("hop") + 1).alias("hop")))
    return reduce(DataFrame.unionByName, rounds).groupBy("way").agg(F.min("hop").alias("hop"))


def _joined(rounds: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """The tables of all rounds, put together sixteen at a time."""
    return [written(reduce(DataFrame.unionByName, [*rounds, new]))] if len(rounds) == 16 else [*rounds, new]


def cycle_lows(links: DataFrame, rounds: int = 5) -> DataFrame:
    """(dart, low, dist): one dart of each cycle, the same for all its darts, and the distance on to it (0 for itself).

    links are (dart, next, dist): every dart's successor on its cycle and the distance to it, with darts as longs. ``rounds`` doublings give every dart the
    least of the 2 ** ``rounds`` darts ahead, in the order of a hash. Only darts that are some dart's least, in a long cycle about two of
    2 ** ``rounds``, go on as a list of their own, and the others follow theirs; so all rounds together cost little more than the first ``rounds``.
    """
    # a path of leasts may pass over a dart, but never over the least of its cycle; where that finds itself, its windows went all around
    at = links.select("dart", "next", F.col("next").alias("low"), "dist", F.col("dist").alias("total"))
    mine, theirs = F.xxhash64("low"), F.xxhash64("_low")
    first = (mine < theirs) | ((mine == theirs) & (F.col("low") <= F.col("_low")))
    for _ in range(rounds):
        there = at.select(*[F.col(c).alias(f"_{c}") for c in at.columns])
        met = at.join(there, F.col("next") == F.col("_dart"))
        low, dist = F.when(first, F.col("low")).otherwise(F.col("_low")), F.when(first, F.col("dist")).otherwise(F.col("total") + F.col("_dist"))
        at = written(met.select("dart", F.col("_next").alias("next"), low.alias("low"), dist.alias("dist"), (F.col("total") + F.col("_total")).alias("total")))
    lows = at.select(F.col("low").alias("_low")).distinct()
    upper = written(at.join(lows, F.col("dart") == F.col("_low"), "left_semi").select("dart", F.col("low").alias("next"), "dist"))
    if upper.where("next <> dart").isEmpty():
        return at.select("dart", "low", F.when(F.col("dart") == F.col("low"), 0).otherwise(F.col("dist")).alias("dist"))
    above = cycle_lows(upper, rounds).select(*[F.col(c).alias(f"_{c}") for c in ("dart", "low", "dist")])
    final = at.join(above, F.col("low") == F.col("_dart"))
    return written(final.select("dart", F.col("_low").alias("low"), F.when(F.col("dart") == F.col("_low"), 0).otherwise(F.col("dist") + F.col("_dist")).alias("dist")))


def distances(edges: DataFrame, sources: DataFrame, reach: float) -> DataFrame:
    """(node, distance): least length over undirected edges (a, b, length) from any source, up to ``reach``.

    Relaxation: each round only nodes whose distance fell pass it on.
    """
    both = _kept(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "length").union(edges.select("b", "a", "length")).groupBy("u", "v").agg(F.min("length").alias("length")))
    known = _kept(sources.select("node").distinct().withColumn("distance", F.lit(0.0)))
    front = known
    while True:
        step = both.join(front, both.u == front.node).select(F.col("v").alias("node"), (F.col("distance") + F.col("length")).alias("distance")).where(F.col("distance") <= reach)
        step = step.groupBy("node").agg(F.min("distance").alias("near"))
        old = known.withColumnRenamed("node", "_old")
        front = _kept(step.join(old, F.col("node") == F.col("_old"), "left").where("distance IS NULL OR near < distance").select("node", F.col("near").alias("distance")))
        if front.isEmpty():
            return known
        known = _kept(known.unionByName(front).groupBy("node").agg(F.min("distance").alias("distance")))


def chains(edges: DataFrame, signature: str) -> DataFrame:
    """(edge, chain): maximal runs of edges (edge, a, b, signature) through nodes of degree two whose two edges agree.

    A chain's name is its smallest edge. Edges that pair at a node are linked, and chains are the
    links' components.
    """
    ends = edges.select("edge", signature, F.explode(F.array("a", "b")).alias("node"))
    pair = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("edge", signature)).alias("lo"), F.max(F.struct("edge", signature)).alias("hi"))
    links = pair.where((F.col("n") == 2) & (F.col("lo.edge") != F.col("hi.edge")) & F.col(f"lo.{signature}").eqNullSafe(F.col(f"hi.{signature}"))).select(F.col("lo.edge").alias("a"), F.col("hi.edge").alias("b"))
    found = components(links)
    return edges.select("edge").join(found, F.col("edge") == F.col("node"), "left").select("edge", F.coalesce("component", "edge").alias("chain"))


def two_arm_joins(edges: DataFrame) -> DataFrame:
    """(node, lo, hi): the two edges that meet at each node of degree two."""
    ends = edges.select("edge", F.explode(F.array("a", "b")).alias("node"))
    both = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("lo"), F.max("edge").alias("hi"))
    return both.where("n = 2 AND lo <> hi").select("node", "lo", "hi")


def _levels(both: DataFrame, starts: DataFrame, rounds: int) -> DataFrame:
    """(start, node, hops): the nodes within ``rounds`` edges of each start; each round joins the newest level alone."""
    front = written(starts.select("start", F.col("start").alias("node")).distinct().withColumn("hops", F.lit(0)))
    seen = front
    for hop in range(1, rounds + 1):
        step = both.join(front, both.u == front.node).select("start", F.col("v").alias("node")).distinct()
        old = seen.select(F.col("start").alias("_s"), F.col("node").alias("_n"))
        front = written(step.join(old, (F.col("start") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def route(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(start, goal, hops): fewest edges between pairs of nodes, for those within ``most`` hops; all pairs advance together.

    Both ends walk half of the way and meet, so a pair costs twice the nodes within ``most`` / 2 edges
    and not those within ``most``. Pairs with a null end have no route.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    wanted = written(pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL").distinct().withColumn("pair", F.monotonically_increasing_id()))
    # the last half-level is by far the largest: it goes once, to its pairs, as lists of neighbours. Lists of nodes with very many are cut by hash.
    degree = written(both.groupBy(F.col("u").alias("_u")).agg(F.count(F.lit(1)).alias("n")))
    top = degree.agg(F.max("n")).first()[0] or 0
    cut = lambda c: F.pmod(F.hash(c), F.lit(math.ceil(top / LIST) or 1))
    lists = written(both.groupBy("u", cut("v").alias("cut")).agg(F.array_sort(F.collect_list("v")).alias("nodes")))
    ends, made = [], 0
    for end, rounds in (("start", (most + 1) // 2), ("goal", most // 2)):
        seen = _levels(both, wanted.select(F.col(end).alias("start")), max(0, rounds - 1))
        at = wanted.select("pair", F.col(end).alias("_end")).join(seen, F.col("_end") == F.col("start")).select("pair", "node", "hops")
        at = written(at)
        rows = [at.select("pair", cut("node").alias("cut"), F.array("node").alias("nodes"), "hops")]
        if rounds:
            front = at.where(F.col("hops") == rounds - 1)
            made += front.join(degree, F.col("node") == F.col("_u")).agg(F.sum("n")).first()[0] or 0
            last = front.join(lists, F.col("node") == F.col("u"))
            rows.append(last.select("pair", "cut", "nodes", F.lit(rounds).alias("hops")))
        ends += [r.withColumn("back", F.lit(end == "goal")) for r in rows]
    # a node's rows of both ends are in one partition, where the lists are opened; as many partitions as the rows in them ask for
    dealt = reduce(DataFrame.union, ends).repartition(max(1, math.ceil(made / MADE)), "pair", "cut").select("pair", "cut", F.explode("nodes").alias("node"), "hops", "back")
    met = dealt.groupBy("pair", "cut", "node").agg((F.min(F.when(~F.col("back"), F.col("hops"))) + F.min(F.when(F.col("back"), F.col("hops")))).alias("hops"))
    least = met.where("hops IS NOT NULL").groupBy("pair").agg(F.min("hops").alias("hops"))
    return least.join(wanted.withColumnRenamed("pair", "_pair"), F.col("pair") == F.col("_pair")).select("start", "goal", "hops")
