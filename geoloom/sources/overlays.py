"""Checks of published building, land-cover and transport rows; each row keeps its reasons, none is dropped.

Geometry is polygons -> rings -> points: ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>; sources are
ARRAY<STRUCT<dataset, license, ...>>. A box is (west, south, east, north) in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They are those of the published schema.
LAND_COVERS = ["barren", "crop", "forest", "grass", "mangrove", "moss", "shrub", "snow", "urban", "wetland"]
HIGH_DETAIL = (8, 15)
HOLES = 16
HOLED_VERTICES = 512
SOURCES = 128


def _reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a null answer breaks none."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda r: r.isNotNull())


def _bad_id(c: str) -> Column:
    return F.col(c).isNull() | ~F.char_length(c).between(1, 128)


def _bad_sources() -> Column:
    named = F.forall("sources", lambda s: F.coalesce(F.char_length(s["dataset"]) > 0, F.lit(False)))
    return F.col("sources").isNull() | ~F.size("sources").between(1, SOURCES) | ~named


def _bad_rings() -> Column:
    ring_ok = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))
    part_ok = lambda p: F.size(p).between(1, HOLES + 1) & F.forall(p, ring_ok)
    return F.col("geometry").isNull() | (F.size("geometry") < 1) | ~F.forall("geometry", part_ok)


def _points() -> Column:
    return F.flatten(F.flatten("geometry"))


def _bad_positions(points: Column) -> Column:
    return ~F.forall(points, lambda p: p["x"].between(-180, 180) & p["y"].between(-80, 84))


def _outside(points: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return (F.array_min(xs) >= east) | (F.array_max(xs) <= west) | (F.array_min(ys) >= north) | (F.array_max(ys) <= south)


def building_rows(rows: DataFrame, box: tuple[float, float, float, float], vertical: bool = False) -> DataFrame:
    """Building rows (id, type, version, height, min_height, has_parts, is_underground, building_id, sources, geometry) with ``reasons``.

    Without ``vertical`` partial and raised buildings are refused; with it a solid states both its heights.
    Repeated ids are for ``repeated_ids`` to find, parents and parts for ``check_parts``.
    """
    part, has_parts = F.coalesce(F.col("type") == "building_part", F.lit(False)), F.coalesce("has_parts", F.lit(False))
    known = F.coalesce("type", F.lit("building")).isin("building", "building_part")
    vertices = lambda p: F.aggregate(p, F.lit(0), lambda n, r: n + F.size(r) - 1)
    raised = part | has_parts | (F.coalesce("min_height", F.lit(0.0)) != 0)
    solid = ~has_parts & (F.col("height").isNull() | F.col("min_height").isNull() | ~F.col("min_height").between(0, 1000))
    reasons = _reasons(
        ("id", _bad_id("id")), ("type", ~known), ("underground", F.col("is_underground")),
        ("vertical", solid if vertical else raised), ("nested", part & has_parts), ("parent", part != F.col("building_id").isNotNull()),
        ("ring", _bad_rings()), ("courtyard", F.exists("geometry", lambda p: (F.size(p) > 1) & (vertices(p) > HOLED_VERTICES))),
        ("position", _bad_positions(_points())), ("outside", _outside(_points(), box)), ("sources", _bad_sources()), ("height", ~F.col("height").between(0.01, 1000)),
    )
    return rows.withColumn("reasons", reasons)


def land_cover_rows(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Land-cover rows (id, subtype, min_zoom, max_zoom, sources, geometry) with ``reasons`` and, for sound ones, a ``disposition``: forest, other-subtype or lower-detail."""
    low, high = F.col("min_zoom"), F.col("max_zoom")
    detailed = (low == HIGH_DETAIL[0]) & (high == HIGH_DETAIL[1])
    zoom = low.isNull() | high.isNull() | ~low.between(0, 15) | ~high.between(0, 15) | (low > high)
    reasons = _reasons(
        ("id", _bad_id("id")), ("subtype", ~F.coalesce(F.col("subtype").isin(LAND_COVERS), F.lit(False))), ("zoom", zoom), ("resolution", ~detailed & (high >= HIGH_DETAIL[0])),
        ("sources", _bad_sources()), ("ring", _bad_rings()), ("position", _bad_positions(_points())), ("outside", _outside(_points(), box)),
    )
    kind = F.when(F.col("subtype") != "forest", "other-subtype").when(detailed, "forest").otherwise("lower-detail")
    return rows.withColumn("reasons", reasons).withColumn("disposition", F.when(F.size("reasons") == 0, kind))


def transport_rows(rows: DataFrame, box: tuple[float, float, float, float], classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(segments, connectors) of rows (id, type, version, subtype, class, level, flags, sources, points), with ``reasons``; every position must lie strictly inside the box.

    A row of neither type counts as a segment, with a reason.
    """
    west, south, east, north = box
    inside = F.forall("points", lambda p: (p["x"] > west) & (p["x"] < east) & (p["y"] > south) & (p["y"] < north))
    common = [("id", _bad_id("id")), ("version", ~F.coalesce(F.col("version").between(1, 2147483647), F.lit(False))), ("sources", _bad_sources()), ("outside", ~inside)]
    connector = F.coalesce(F.col("type") == "connector", F.lit(False))
    road = F.coalesce((F.col("subtype") == "road") & F.col("class").isin(classes), F.lit(False))
    line = F.coalesce((F.size("points") >= 2) & (F.size(F.array_distinct("points")) == F.size("points")), F.lit(False))
    segment = [("type", ~F.coalesce(F.col("type") == "segment", F.lit(False))), ("line", ~line), ("class", ~road), ("level", F.coalesce("level", F.lit(0)) != 0), ("flags", F.exists("flags", lambda f: f != "is_link"))]
    point = [("point", ~F.coalesce(F.size("points") == 1, F.lit(False)))]
    return rows.where(~connector).withColumn("reasons", _reasons(*common, *segment)), rows.where(connector).withColumn("reasons", _reasons(*common, *point))
