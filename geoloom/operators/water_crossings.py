"""Roads over water without a bridge tag: a chain of roads between two dry ends is one, anything else stays unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.carriageways import ranked
from geoloom.operators.graph import written
from geoloom.operators.structures import _arms, _both, _joins

#: Metres of water that a way must hold to count as wet, and that a chain must cross. Fixed values.
WET = 0.1
ACROSS = 2.0


def crossing_paths(ways: DataFrame, joins: DataFrame, plain: DataFrame) -> DataFrame:
    """(path, pos, way): ways (id, a, b, excluded) that are not excluded, in the order in which they follow each other.

    Ways go on where two of them meet end to end and nothing else does, into ways that no road meets between their ends (plain). A way that others meet can be a path's start
    only: it takes the plain chain beside it if its id is smaller than the chain's and than that of the other such way. Closed chains are left out: they have no ends.
    """
    free = ways.where("NOT excluded").select("id")
    flat = written(free.join(plain.select(F.col("id").alias("_p")), F.col("id") == F.col("_p"), "left").select("id", F.col("_p").isNotNull().alias("plain")))
    tag = lambda n: flat.select(F.col("id").alias(f"_{n}"), F.col("plain").alias(n))
    steps = written(_both(joins).join(tag("p"), F.col("from.way") == F.col("_p")).join(tag("q"), F.col("to.way") == F.col("_q")).select("from", "to", "p", "q"))
    dart = lambda way, side: F.struct(way.alias("way"), side.alias("side"))
    prev = steps.where("p AND q").select(dart(F.col("to.way"), F.col("to.side")).alias("_dart"), dart(F.col("from.way"), 1 - F.col("from.side")).alias("prev"))
    darts = flat.where("plain").select(F.explode(F.array(*[dart(F.col("id"), F.lit(s)) for s in (0, 1)])).alias("id"))
    order = written(ranked(darts.join(prev, F.col("id") == F.col("_dart"), "left").select("id", "prev")))
    low = order.groupBy(F.col("first").alias("_f")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size"), F.max_by("id", "rank").alias("last")).where("low.side = 0")
    chains = written(order.join(low, F.col("first") == F.col("_f")).select(F.col("low.way").alias("chain"), "rank", F.col("id.way").alias("way"), "size", F.col("first").alias("head"), "last"))
    # ways that others meet, at a chain's head (end 0) or tail (end 1); ``side`` is theirs
    beside = steps.where("p AND NOT q").select(F.col("from").alias("_from"), F.col("to.way").alias("start"), F.col("to.side").alias("side"))
    ports = chains.where("rank = 0").select("chain", F.explode(F.array(F.struct(F.lit(0).alias("end"), dart(F.col("head.way"), F.col("head.side")).alias("port")), F.struct(F.lit(1).alias("end"), dart(F.col("last.way"), 1 - F.col("last.side")).alias("port")))).alias("e")).select("chain", "e.*")
    tied = written(ports.join(beside, F.col("port") == F.col("_from")).select("chain", "end", "start", "side"))
    owner = tied.groupBy("chain").agg(F.min(F.struct("start", "end", "side")).alias("o"), F.count(F.lit(1)).alias("n"), F.count_distinct("start").alias("starts"))
    owner = owner.where("o.start < chain").select(F.col("chain").alias("_c"), "o.*", (F.col("n") > F.col("starts")).alias("round"))
    placed = written(chains.join(owner, F.col("chain") == F.col("_c"), "left"))
    rank, size = F.col("rank"), F.col("size")
    pos = F.when(F.col("start").isNull(), rank).when(F.col("side") == 0, F.when(F.col("end") == 1, rank - size).otherwise(-rank - 1)).otherwise(F.when(F.col("end") == 0, rank + 1).otherwise(size - rank))
    alone = flat.where("NOT plain").select(F.col("id").alias("path"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("way"))
    closed = placed.where("round").select(F.col("start").alias("_r")).distinct()
    both = placed.select(F.coalesce("start", "chain").alias("path"), pos.alias("pos"), "way").unionByName(alone)
    return both.join(closed, F.col("path") == F.col("_r"), "left_anti")


def water_crossings(ways: DataFrame, vertices: DataFrame, wet: DataFrame, dry: DataFrame) -> DataFrame:
    """(id, verdict, path, wet, doubt): a row for every way (id, a, b, bridge, excluded) that touches water or is part of a crossing.

    vertices are (id, seq, ref) with seq from 1, wet (id, wet) metres in water, dry the nodes (node) well away from it. Verdicts: ``exception`` (a ford, tunnel or embankment; in doubt
    if it is tagged a bridge too), ``explicit`` (a tagged bridge), ``inferred`` (between the first and the last wet way of a path that meets no node twice,
    has two dry ends and crosses 2 m or more; ``path`` is named), ``unresolved`` (in doubt). Empty tables give no rows.
    """
    ways = written(ways.join(wet.groupBy(F.col("id").alias("_w")).agg(F.max("wet").alias("wet")), F.col("id") == F.col("_w"), "left").drop("_w").withColumn("wet", F.coalesce("wet", F.lit(0.0))))
    arms, plain = _arms(ways, vertices)
    paths = written(crossing_paths(ways, _joins(ways, arms), written(plain)))
    own = written(paths.join(ways.select("id", "a", "b", "wet"), F.col("way") == F.col("id")))
    sums = own.groupBy("path").agg(F.sum("wet").alias("sum"), F.count(F.lit(1)).alias("ways"), F.min(F.when(F.col("wet") > WET, F.col("pos"))).alias("lo"), F.max(F.when(F.col("wet") > WET, F.col("pos"))).alias("hi"))
    loose = own.select("path", F.explode(F.array("a", "b")).alias("node")).groupBy("path", "node").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    ends = loose.join(dry.select(F.col("node").alias("_d")).distinct(), F.col("node") == F.col("_d"), "left_semi").groupBy(F.col("path").alias("_e")).agg(F.count(F.lit(1)).alias("ends"))
    nodes = paths.join(vertices.select(F.col("id").alias("_v"), "ref"), F.col("way") == F.col("_v")).groupBy(F.col("path").alias("_n")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref").alias("refs"))
    good = sums.join(ends, F.col("path") == F.col("_e")).join(nodes, F.col("path") == F.col("_n")).where((F.col("sum") >= ACROSS) & F.col("lo").isNotNull() & (F.col("ends") == 2) & (F.col("n") - F.col("ways") + 1 == F.col("refs")))
    good = good.select(F.col("path").alias("_g"), "lo", "hi")
    inferred = paths.join(good, F.col("path") == F.col("_g")).where("pos BETWEEN lo AND hi").select(F.col("way").alias("_i"), "path")
    all_ = ways.join(inferred, F.col("id") == F.col("_i"), "left").where((F.col("wet") > WET) | F.col("path").isNotNull())
    verdict = F.when(F.col("excluded"), "exception").when(F.col("bridge"), "explicit").when(F.col("path").isNotNull(), "inferred").otherwise("unresolved")
    judged = all_.withColumn("verdict", verdict)
    doubt = (F.col("verdict") == "unresolved") | (F.col("excluded") & F.col("bridge"))
    return judged.select("id", "verdict", F.when(F.col("verdict") == "inferred", F.col("path")).alias("path"), "wet", doubt.alias("doubt"))
