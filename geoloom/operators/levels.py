"""Levels of touching water: units join the most similar neighbour first while their shores stay within range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graph import written

#: Least value of a bound that a unit does not set.
NONE = -(1 << 40)


def _joined(units: DataFrame, edges: DataFrame, level_range: int, stretch_range: int) -> tuple[DataFrame, int]:
    """units (id, grp, lo, mid, hi: those of the group) after joining along edges (a, b, rank), and the number of rounds."""
    place = units.select(F.col("id").alias("_id"), F.col("grp").alias("_grp"))
    open_ = edges.join(place, F.col("a") == F.col("_id")).withColumnRenamed("_grp", "ga").drop("_id").join(place, F.col("b") == F.col("_id")).withColumnRenamed("_grp", "gb").drop("_id").select("ga", "gb", "rank")
    rounds = 0
    while True:
        of = units.groupBy(F.col("grp").alias("_g")).agg(F.min("lo").alias("lo"), F.max("mid").alias("mid"), F.max("hi").alias("hi"))
        groups = written(of)
        near = open_.where("ga <> gb")
        for side in "ab":
            near = near.join(groups.select(F.col("_g"), *[F.col(c).alias(f"{c}_{side}") for c in ("lo", "mid", "hi")]), F.col(f"g{side}") == F.col("_g")).drop("_g")
        level = F.least("lo_a", "lo_b")
        # ranges only widen, so what is out of range stays out
        fits = (F.greatest("mid_a", "mid_b") - level <= level_range) & (F.greatest("hi_a", "hi_b") - level <= stretch_range)
        open_ = written(near.where(fits).select("ga", "gb", "rank"))
        if open_.isEmpty():
            return units, rounds
        rounds += 1
        ends = open_.select(F.explode(F.array("ga", "gb")).alias("g"), "rank")
        first = written(ends.groupBy("g").agg(F.min("rank").alias("first")))
        ready = open_
        for side in "ab":
            ready = ready.join(first.select(F.col("g").alias("_g"), F.col("first").alias("_f")), (F.col(f"g{side}") == F.col("_g")) & (F.col("rank") == F.col("_f"))).drop("_g", "_f")
        # an edge that comes first for both its groups is decided before any other of theirs; such edges share no group
        moves = written(ready.select(F.greatest("ga", "gb").alias("_old"), F.least("ga", "gb").alias("_new")))
        units = written(units.join(moves, F.col("grp") == F.col("_old"), "left").withColumn("grp", F.coalesce("_new", "grp")).drop("_old", "_new"))
        for side in ("ga", "gb"):
            open_ = open_.join(moves, F.col(side) == F.col("_old"), "left").withColumn(side, F.coalesce("_new", side)).drop("_old", "_new")


def join_levels(units: DataFrame, edges: DataFrame, level_range: int, stretch_range: int) -> tuple[DataFrame, int]:
    """(id, grp, level) of units (id, low, median, high, tight) that touch along edges (a, b), and the number of rounds.

    Edges join in order of the difference of their units' lows, ties by the smaller and the larger id: first those between wide units, then all.
    Two groups join if no wide member's median and no tight member's high is more than ``level_range`` or ``stretch_range`` above their
    lowest low, which becomes the level. A group is named by its smallest unit. Edges of unknown units, loops and repeats count for nothing.

    It gives what one serial run gives. All edges that come first for both their groups are decided at once, so rounds are as many as the
    longest chain of decisions that wait for each other: few where similarity is mixed, one a unit where it falls along a line.
    """
    own = units.select("id", F.col("id").alias("grp"), F.col("low").alias("lo"), F.when(F.col("tight"), F.lit(NONE)).otherwise(F.col("median")).alias("mid"), F.when(F.col("tight"), F.col("high")).otherwise(F.lit(NONE)).alias("hi"))
    own = written(own)
    known = units.select(F.col("id").alias("_u"), "low", "tight")
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    for side in "ab":
        pairs = pairs.join(known.select("_u", F.col("low").alias(f"low_{side}"), F.col("tight").alias(f"tight_{side}")), F.col(side) == F.col("_u")).drop("_u")
    ranked = written(pairs.select("a", "b", F.struct(F.abs(F.col("low_a") - F.col("low_b")).alias("d"), "a", "b").alias("rank"), (F.col("tight_a") | F.col("tight_b")).alias("narrow")))
    wide, first = _joined(own, ranked.where("NOT narrow"), level_range, stretch_range)
    final, second = _joined(wide, ranked, level_range, stretch_range)
    level = final.groupBy(F.col("grp").alias("_g")).agg(F.min("lo").alias("level"))
    return final.select("id", "grp").join(level, F.col("grp") == F.col("_g")).select("id", "grp", "level"), first + second
