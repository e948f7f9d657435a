"""Grouped aggregates of the map data: junctions, envelopes, votes, evidence, limits, coverage, lineage.

All are partial and final hash aggregations; a frequent key is summed up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_nodes(way_nodes: DataFrame) -> DataFrame:
    """(ref, n_ways, arms): nodes where at least two ways meet; arms counts all incidences."""
    per_way = way_nodes.groupBy("ref", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_way.groupBy("ref").agg(F.count(F.lit(1)).alias("n_ways"), F.sum("n").alias("arms")).where("n_ways >= 2")


def node_arms(way_nodes: DataFrame) -> DataFrame:
    """(ref, arms): a way's end counts one arm, an interior vertex two."""
    last = F.max("seq").over(Window.partitionBy("id"))
    first = F.min("seq").over(Window.partitionBy("id"))
    ends = way_nodes.withColumn("_arms", F.when((F.col("seq") == first) | (F.col("seq") == last), 1).otherwise(2))
    return ends.groupBy("ref").agg(F.sum("_arms").alias("arms"))


def edges(way_nodes: DataFrame) -> DataFrame:
    """(id, a, b): neighbouring nodes of each way."""
    order = Window.partitionBy("id").orderBy("seq")
    return way_nodes.select("id", F.col("ref").alias("a"), F.lead("ref").over(order).alias("b")).where("b IS NOT NULL")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(node, degree) over both ends of all edges."""
    ends = edge_rows.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def topology(edge_rows: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, cycle rank E - V + C, junctions (degree over 2) and dead ends."""
    d = degrees(edge_rows).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.count_if(F.col("degree") > 2).alias("junctions"), F.count_if(F.col("degree") == 1).alias("dead_ends"))
    c = components.agg(F.count_distinct("component").alias("components"))
    return d.join(F.broadcast(c)).withColumn("cycle_rank", F.col("edges") - F.col("nodes") + F.col("components"))


def envelopes(points: DataFrame, key: str = "id") -> DataFrame:
    return points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def evidence_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, basis, n) over the basis columns of several dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("basis")) for c in dimensions])).alias("p")
    return df.select(pairs).groupBy("p.dimension", "p.basis").agg(F.count(F.lit(1)).alias("n"))


def limit_ledger(events: DataFrame) -> DataFrame:
    """(code, n, actual, refused) from (code, actual, refused) events; ledgers merge by the same aggregate."""
    return events.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("actual").alias("actual"), F.bool_or("refused").alias("refused"))


def vote(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value): the value of the largest total weight, ties to the larger value."""
    sums = df.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(key).agg(F.max(F.struct("_w", value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value), F.col("_m._w").alias("weight"))


def neighbour_median(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(id, median, n) of the neighbours' heights (id, h), null with fewer than ``least``; also whether all are low."""
    return pairs.groupBy("id").agg(F.median("h").alias("m"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("h") < 12).alias("low")).select("id", F.when(F.col("n") >= least, F.col("m")).alias("median"), "n", (F.col("low") & (F.col("n") >= least)).alias("all_low"))


def storeys(median: Column, level: float = 3.0) -> Column:
    return F.floor(median / level + 0.5)


def weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def complexes(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def group_records(df: DataFrame, key: str, sources: str, names: str, flag: str) -> DataFrame:
    """Records of a key joined: sorted distinct sources and names, and whether any is flagged.

    Values are made distinct before they are gathered, so a list is as long as a key has different ones;
    nulls are left out.
    """
    out = df.groupBy(key).agg(F.bool_or(flag).alias(flag))
    for c in (sources, names):
        each = df.select(F.col(key).alias("_key"), F.explode(c).alias("_value")).distinct()
        found = each.groupBy("_key").agg(F.array_sort(F.collect_list("_value")).alias(c))
        out = out.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        out = out.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return out.select(key, sources, names, flag)


def grades(arcs: DataFrame, z: Column, z2: Column, straight: float) -> DataFrame:
    """(id, max_grade, long_stretches) of lines given as arc_length() rows with heights of both ends."""
    g = arcs.where("len > 0").select("id", "len", (F.abs(z2 - z) / F.col("len")).alias("_g"))
    return g.groupBy("id").agg(F.max("_g").alias("max_grade"), F.count_if(F.col("len") >= straight).alias("long_stretches"))


def density(cells: DataFrame, limit: int) -> DataFrame:
    """Counts per cell with a band: over, high (from three quarters of the limit) or normal."""
    n = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("band", F.when(F.col("n") > limit, "over").when(F.col("n") * 4 >= limit * 3, "high").otherwise("normal"))


def uncovered(inputs: DataFrame, outputs: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, fault): inputs neither represented nor excluded, and outputs or exclusions that are no input."""
    known = outputs.select("id").union(excluded.select("id")).distinct()
    lost = inputs.select("id").distinct().exceptAll(known).withColumn("fault", F.lit("lost"))
    return lost.unionByName(known.exceptAll(inputs.select("id").distinct()).withColumn("fault", F.lit("unknown")))


def majority(df: DataFrame, key: str, value: str, area: str) -> DataFrame:
    """(key, value): the value covering most area, ties to the name that sorts first; all values are kept in ``covering``."""
    sums = df.groupBy(key, value).agg(F.sum(area).alias("_a"))
    return sums.groupBy(key).agg(F.min(F.struct((-F.col("_a")).alias("n"), F.col(value).alias("v"))).alias("m"), F.array_sort(F.collect_set(value)).alias("covering")).select(key, F.col("m.v").alias(value), "covering")


def pair_lengths(matches: DataFrame, least: float) -> DataFrame:
    """(lo, hi, length): total length per unordered pair, at least ``least``."""
    return matches.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum("length").alias("length")).where(F.col("length") >= least)


def cell_signatures(records: DataFrame) -> DataFrame:
    """(cx, cy, n, signature): the sum of 60 bits of each record's SHA-256, which no order changes and in which repeats count; null records count in n alone."""
    h = F.conv(F.substring(F.sha2("record", 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return records.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("signature"))


def lineage(records: DataFrame) -> DataFrame:
    """(source, first, n): for every source id, the first position and number of records made from it."""
    each = records.select("position", F.explode("sources").alias("source"))
    return each.groupBy("source").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
