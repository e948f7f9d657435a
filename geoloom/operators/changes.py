"""Keyed change sets: diffs, batches with before-images, undo, and records owned by a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, before, after): insert, delete or update of whole records; unchanged keys are left out."""
    rest = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("_kb"), F.struct(*rest).alias("before"))
    a = after.select(F.col(key).alias("_ka"), F.struct(*rest).alias("after"))
    both = b.join(a, F.col("_kb") == F.col("_ka"), "full_outer")
    kind = F.when(F.col("_kb").isNull(), "insert").when(F.col("_ka").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.select(F.coalesce("_kb", "_ka").alias(key), kind.alias("kind"), "before", "after").where("kind IS NOT NULL")


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """base with the changes applied, and the changes (key, fault) that are stale or repeated. With any fault, base stays as it is."""
    rest = [c for c in base.columns if c != key]
    own = base.select(F.col(key).alias("_kb"), F.struct(*rest).alias("_now"))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    both = changes.withColumn("_n", n).withColumnRenamed(key, "_kc").join(own, F.col("_kc") == F.col("_kb"), "full_outer")
    stale = ~F.col("before").eqNullSafe(F.col("_now"))
    fault = F.when(F.col("_kc").isNull(), None).when(F.col("_n") > 1, "repeated").when(stale, "stale")
    judged = both.withColumn("_fault", fault)
    faults = judged.where("_fault IS NOT NULL").select(F.col("_kc").alias(key), F.col("_fault").alias("fault")).distinct()
    any_fault = F.broadcast(faults.agg((F.count(F.lit(1)) > 0).alias("_refuse")))  # one row
    image = F.when(F.col("_kc").isNull() | F.col("_refuse"), F.col("_now")).otherwise(F.col("after"))
    out = judged.join(any_fault).withColumn("_image", image).where("_image IS NOT NULL").select(F.coalesce("_kb", "_kc").alias(key), "_image.*")
    return out.dropDuplicates([key]).select(base.columns), faults


def reverse(changes: DataFrame) -> DataFrame:
    """The batch that undoes a batch: images swapped."""
    kinds = F.when(F.col("kind") == "insert", "delete").when(F.col("kind") == "delete", "insert").otherwise(F.col("kind"))
    return changes.withColumns({"kind": kinds, "before": F.col("after"), "after": F.col("before")})


def coalesce(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """Per key the first before-image and the last after-image of a sequence of changes; no-ops go."""
    both = batch.groupBy(key).agg(F.min_by("before", seq).alias("before"), F.max_by("after", seq).alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def key_set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def regenerate(owned: DataFrame, current: DataFrame, fresh: DataFrame, key: str, group: str, image: str) -> DataFrame:
    """(key, action): what happens to each record when its generator runs again.

    Unchanged owned records are replaced, edited ones kept, deleted ones stay deleted; one edited member
    freezes its whole group. Fresh records of groups that aren't frozen, and whose key is new, are added.
    """
    o = owned.select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(image).alias("_was"))
    c = current.select(F.col(key).alias("_ck"), F.col(image).alias("_is"))
    state = F.when(F.col("_ck").isNull(), "deleted").when(F.col("_was").eqNullSafe(F.col("_is")), "same").otherwise("edited")
    judged = o.join(c, F.col("_k") == F.col("_ck"), "left").withColumn("_state", state)
    frozen = judged.groupBy("_g").agg(F.bool_or(F.col("_state") == "edited").alias("_frozen"))
    own = judged.join(frozen.withColumnRenamed("_g", "_fg"), F.col("_g") == F.col("_fg"))
    action = F.when(F.col("_state") == "deleted", "tombstone").when(F.col("_frozen"), "keep").otherwise("replace")
    kept = own.select(F.col("_k").alias(key), action.alias("action"))
    new = fresh.join(o.select("_k"), F.col(key) == F.col("_k"), "left_anti").join(frozen, F.col(group) == F.col("_g"), "left")
    return kept.unionByName(new.where(~F.coalesce("_frozen", F.lit(False))).select(key, F.lit("add").alias("action")))


def resolve(value: str, *candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """The first candidate value that isn't null, and the name of where it came from: (value, evidence)."""
    found = F.coalesce(*[c for _, c in candidates]).alias(value)
    basis = F.lit(None).cast("string")
    for name, c in reversed(candidates):
        basis = F.when(c.isNotNull(), name).otherwise(basis)
    return found, basis.alias(f"{value}_basis")


def split(df: DataFrame, *reasons: tuple[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the first ``reason`` that holds; an unknown (null) test does not reject."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        reason = F.when(F.coalesce(test, F.lit(False)), name).otherwise(reason)
    judged = df.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
