"""Joins that resolve references, complete regions, nest parts and apply edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(way_nodes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Way vertices (id, seq, ref) with their coordinates, and the ways (id, missing) that lack a node; those are left out."""
    n = nodes.select(F.col("id").alias("_node"), "x", "y")
    joined = way_nodes.join(n, F.col("ref") == F.col("_node"), "left")
    missing = joined.where("_node IS NULL").groupBy("id").agg(F.count(F.lit(1)).alias("missing"))
    return joined.drop("_node").join(missing.select(F.col("id").alias("_bad")), F.col("id") == F.col("_bad"), "left_anti"), missing


def with_tags(way_nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Way vertices with the tags of their node, where it has any."""
    return way_nodes.join(tags.withColumnRenamed("id", "_node"), F.col("ref") == F.col("_node"), "left").drop("_node")


def resolve_members(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relation members (relation, type, ref, role) joined to ways or nodes by type: adds ``found``."""
    parts = []
    for kind, known in (("way", ways), ("node", nodes)):
        ids = known.select(F.col("id").alias("_id")).distinct()
        parts.append(members.where(F.col("type") == kind).join(ids, F.col("ref") == F.col("_id"), "left").withColumn("found", F.col("_id").isNotNull()).drop("_id"))
    return parts[0].unionByName(parts[1])


def touching(way_nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): ways that use any of the given node ids."""
    return way_nodes.join(ids.select(F.col("id").alias("_id")), F.col("ref") == F.col("_id"), "left_semi").select("id").distinct()


def complete_nodes(way_nodes: DataFrame, ways: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(id): the given nodes and all nodes of the given ways."""
    of_ways = way_nodes.join(ways.select(F.col("id").alias("_way")), F.col("id") == F.col("_way"), "left_semi").select(F.col("ref").alias("id"))
    return node_ids.select("id").union(of_ways).distinct()


def drop_blocked(rows: DataFrame, blocked: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the blocked ones."""
    return rows.join(blocked.select(F.col(key).alias("_blocked")), F.col(key) == F.col("_blocked"), "left_anti")


def attach_parts(parents: DataFrame, parts: DataFrame, parent_key: str, *columns: str, most: int = 10_000) -> DataFrame:
    """Parents with their parts as a sorted array of structs; without parts, an empty one.

    A parent holds at most ``most`` parts. They are counted first, and a parent with more is an error before its parts meet in one value.
    """
    counts = parts.groupBy(F.col(parent_key).alias("_counted")).agg(F.count(F.lit(1)).alias("_n"))
    too_many = F.raise_error(F.concat(F.lit(f"more than {most} parts: "), F.col("_counted").cast("string")))
    few = counts.where(F.when(F.col("_n") <= most, True).otherwise(too_many.cast("boolean"))).select("_counted")
    kept = parts.join(few, F.col(parent_key) == F.col("_counted"), "left_semi").groupBy(parent_key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parts"))
    joined = parents.join(kept.withColumnRenamed(parent_key, "_parent"), F.col(parent_key) == F.col("_parent"), "left").drop("_parent")
    empty = F.array().cast(kept.schema["parts"].dataType)
    return joined.withColumn("parts", F.coalesce("parts", empty))


def incomplete(parents: DataFrame, parts: DataFrame, key: str, expects: Column) -> DataFrame:
    """(key, fault): parents that expect parts and have none, and parts without their parent."""
    ids = parts.select(F.col(key).alias("_part")).where("_part IS NOT NULL").distinct()
    both = parents.select(key, expects.alias("_expects")).join(ids, F.col(key) == F.col("_part"), "full_outer")
    fault = F.when(F.col(key).isNull(), "no parent").when(F.col("_expects") & F.col("_part").isNull(), "no parts")
    return both.select(F.coalesce(key, "_part").alias(key), fault.alias("fault")).where("fault IS NOT NULL")


def site_of(members: DataFrame) -> DataFrame:
    """(type, ref, site): the smallest relation of each member."""
    return members.groupBy("type", "ref").agg(F.min("relation").alias("site"))


def match_by_source_id(a: DataFrame, b: DataFrame, pattern: str) -> DataFrame:
    """(a_id, b_id): rows whose ``record`` texts name the same source id."""
    left = a.select(F.col("id").alias("a_id"), F.regexp_extract("record", pattern, 1).alias("_s")).where("_s <> ''")
    right = b.select(F.col("id").alias("b_id"), F.regexp_extract("record", pattern, 1).alias("_t")).where("_t <> ''")
    return left.join(right, F.col("_s") == F.col("_t")).select("a_id", "b_id")


def apply_overrides(rows: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the edits' values where given, and the edits that have no row. All or nothing: with any such edit, no row changes."""
    e = edits.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    lost = e.join(rows.select(key), F.col("_key") == F.col(key), "left_anti")
    n_lost = lost.agg(F.count(F.lit(1)).alias("_lost"))
    joined = rows.join(e, F.col(key) == F.col("_key"), "left").join(F.broadcast(n_lost))  # one row
    out = [F.when((F.col("_lost") == 0) & F.col("_key").isNotNull(), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return joined.select(*out), lost


def fill_missing(rows: DataFrame, supplement: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose missing values come from the supplement, and the supplement's rows (key, fault) that conflict or are unknown."""
    s = supplement.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    joined = rows.join(s, F.col(key) == F.col("_key"), "full_outer")
    fault = F.when(F.col(key).isNull(), "unknown").when(F.col("_key").isNotNull() & F.col(column).isNotNull() & (F.col(column) != F.col("_value")), "conflict")
    faults = joined.select(F.col("_key").alias(key), fault.alias("fault")).where("fault IS NOT NULL")
    filled = joined.where(F.col(key).isNotNull()).withColumn(column, F.coalesce(column, "_value")).select(rows.columns)
    return filled, faults


def rule_spans(rules: DataFrame) -> DataFrame:
    """(id, lo, hi): the spans between all distinct ends of an id's rules (id, lo, hi)."""
    from pyspark.sql import Window

    cuts = rules.select("id", F.col("lo").alias("c")).union(rules.select("id", "hi")).distinct()
    return cuts.select("id", F.col("c").alias("lo"), F.lead("c").over(Window.partitionBy("id").orderBy("c")).alias("hi")).where("hi IS NOT NULL")


def interval_join(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans (id, lo, hi) with the value of the rule of the same id that holds their start: lo <= start < hi."""
    r = rules.select(F.col("id").alias("_id"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "value")
    return spans.join(r, (F.col("id") == F.col("_id")) & (F.col("lo") >= F.col("_lo")) & (F.col("lo") < F.col("_hi")), "left").drop("_id", "_lo", "_hi")


def anchors(entities: DataFrame, names: list[str], query: str) -> DataFrame:
    """Entities of which any of the name tags equals the query."""
    return entities.where(F.exists(F.array(*[F.lit(n) for n in names]), lambda k: F.coalesce(F.try_element_at("tags", k) == query, F.lit(False))))
