"""Places, identities and listings: containing areas, sets of ids, absorbed duplicates, ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.spatial import bilinear, box_join, points_in_polygons

# Places that are settlements, larger ones first, and keys of landmarks.
SETTLEMENTS = ("city", "town", "village", "suburb", "quarter", "neighbourhood", "borough", "hamlet", "isolated_dwelling", "locality", "square")
LANDMARK_KEYS = ("amenity", "tourism", "historic", "leisure", "aeroway", "railway")


def union_ids(*sets: DataFrame) -> DataFrame:
    """The ids of all sets, each once."""
    out = sets[0].select("id")
    for more in sets[1:]:
        out = out.unionByName(more.select("id"))
    return out.distinct()


def in_either(rows: DataFrame, key: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows whose key is an id of one of two sets."""
    ids = union_ids(a, b).withColumnRenamed("id", "_known")
    return rows.join(ids, F.col(key) == F.col("_known"), "left_semi")


def insert_or_ignore(known: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """known, and of new the rows whose key it lacks; several new rows of a key leave one, the smallest."""
    names = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*names)).alias("_row")).select(key, "_row.*")
    return known.unionByName(first.join(known.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti"))


def absorbed(owners: DataFrame, sources: DataFrame, cell: int) -> DataFrame:
    """(id, owner): sources (id, x0, y0, x1, y1) that an owner covers whole, with the owner that is largest, ties to the smaller id."""
    pairs = box_join(owners, sources, cell)
    whole = pairs.where((F.col("a_x0") <= F.col("b_x0")) & (F.col("a_y0") <= F.col("b_y0")) & (F.col("a_x1") >= F.col("b_x1")) & (F.col("a_y1") >= F.col("b_y1")))
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    best = F.min(F.struct((-area).alias("far"), F.col("a_id").alias("owner")))
    return whole.groupBy(F.col("b_id").alias("id")).agg(best.alias("best")).select("id", F.col("best.owner").alias("owner"))


def in_band(shares: DataFrame, low: float, high: float, slack: float = 0.005) -> DataFrame:
    """Shares (id, share) rounded to four places, with whether they lie in the target band."""
    return shares.withColumn("fits", F.col("share").between(low - slack, high + slack)).withColumn("share", F.round("share", 4))


def ground_points(points: DataFrame, grid: DataFrame, west: float, south: float, step: float) -> DataFrame:
    """points (id, x, y, ...) with their ground ``h``, one sample each; null where the grid has no support."""
    found = bilinear(points, grid, west, south, step).withColumnRenamed("id", "_id")
    return points.join(found, F.col("id") == F.col("_id"), "left").drop("_id")


def tier(place, *landmarks):
    """Settlements first (larger first), then landmarks, then the rest."""
    order = F.array_position(F.array(*map(F.lit, SETTLEMENTS)), place)
    some = F.coalesce(F.greatest(*[F.coalesce(x != "", F.lit(False)) for x in landmarks]), F.lit(False)) if len(landmarks) > 1 else F.coalesce(landmarks[0] != "", F.lit(False))
    return F.when(order > 0, order.cast("int") - 1).when(some, 20).otherwise(30)


def anchors(places: DataFrame, most: int = 16) -> DataFrame:
    """The first ``most`` places (issue, tier, id)."""
    return places.orderBy("issue", "tier", "id").limit(most)


def busiest(rows: DataFrame, *measures: str, key: str = "id") -> DataFrame:
    """Rows with the largest measures first, ties by key."""
    return rows.orderBy(*[F.desc(m) for m in measures], key)


def canonical_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows in an order that depends on their values alone: the named columns, then all others by name."""
    return rows.orderBy(*first, *sorted(c for c in rows.columns if c not in first))


def located(points: DataFrame, areas: DataFrame, edges: DataFrame, cell: int) -> DataFrame:
    """(id, areas, code, basis): for each point the areas that contain it, largest first, and its country.

    ``areas`` has id, level, country, subdivision and km2. The country is that of the largest containing
    area of level 2 that has one, else the first half of the subdivision of the smallest area that has
    one, else the only country that any area names.
    """
    inside = points_in_polygons(points, edges, cell).withColumnRenamed("id", "point")
    hit = inside.join(areas, F.col("polygon") == areas.id)
    own = F.when((F.col("level") == 2) & (F.col("country") != ""), F.struct((-F.col("km2")).alias("far"), "id", "country"))
    part = F.when(F.col("subdivision").contains("-"), F.struct("km2", (-F.col("id")).alias("far"), "subdivision"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("km2")).alias("far"), "id"))), lambda x: x["id"])  # as many as areas lie over each other
    found = hit.groupBy("point").agg(listed.alias("areas"), F.min(own).alias("own"), F.min(part).alias("part"))
    named = areas.where((F.col("level") == 2) & (F.col("country") != "")).agg(F.min("country").alias("least"), F.max("country").alias("greatest"))
    all_ = points.select("id").join(found, F.col("id") == F.col("point"), "left").crossJoin(F.broadcast(named))  # one row
    only = F.col("least") == F.col("greatest")
    half = F.upper(F.substring(F.split("part.subdivision", "-")[0], 1, 2))
    code = F.when(F.col("own").isNotNull(), F.col("own.country")).when(F.col("part").isNotNull(), half).when(only, F.col("least"))
    basis = F.when(F.col("own").isNotNull(), "boundary").when(F.col("part").isNotNull(), "subdivision").when(only, "extract")
    return all_.select("id", F.coalesce("areas", F.array().cast(found.schema["areas"].dataType)).alias("areas"), code.alias("code"), basis.alias("basis"))
