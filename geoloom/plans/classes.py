"""Queries over rule classification: parts and orders carry tags made from their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import rules as R
from geoloom.plans.base import query, table

ROADS = ["residential", "primary", "motorway", "footway"]
LANES = ["2", "4", "x", "20"]


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _sql(values: list, k: str) -> str:
    return f"[{', '.join(repr(v) if v is not None else 'NULL' for v in values)}][{k} % {len(values)} + 1]"


def _tags(key: Column, **values: list) -> Column:
    pairs = [x for i, (name, vs) in enumerate(values.items()) for x in (F.lit(name.replace("__", ":")), _pick(vs, F.floor(key / (4**i)).cast("bigint")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _columns(key: str, **values: list) -> str:
    return ", ".join(f"{_sql(vs, f'({key} // {4**i})')} AS {name}" for i, (name, vs) in enumerate(values.items()))


AREA = {"highway": [None, None, "residential", ""], "building": [None, "no", "yes"], "landuse": [None, "forest", "grass"], "natural": [None, "wood", "water", "sand"], "barrier": [None, "hedge"], "waterway": ["river", None]}


@query("prj05_category", f"WITH t AS (SELECT o_orderkey, {_columns('o_orderkey', **AREA)} FROM orders), k AS (SELECT *, coalesce(highway <> '', false) AS r, coalesce(building <> 'no', false) AS b, coalesce(landuse = 'forest', false) OR coalesce(natural_ = 'wood', false) AS z FROM (SELECT * RENAME (\"natural\" AS natural_) FROM t)) SELECT o_orderkey, CASE WHEN r::INT + b::INT + z::INT > 1 THEN 'ambiguous' WHEN r THEN 'road' WHEN b THEN 'building' WHEN z THEN 'zone' WHEN landuse IS NOT NULL OR natural_ IN ('water') THEN 'region' WHEN natural_ = 'sand' THEN 'region' WHEN barrier = 'hedge' THEN 'barrier' WHEN waterway = 'river' THEN 'waterway' END AS category FROM k".replace("AS natural,", 'AS "natural",'))
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.category(_tags(F.col("o_orderkey"), **AREA), city=True).alias("category"))


WAY = {"oneway": [None, "yes", "-1", "no"], "highway": ROADS, "lanes": [None, "2", "20", "x"], "lanes__forward": [None, "1", "3"], "lanes__backward": [None, "2"], "width": [None, "7.5", "6 m", "wide"]}
_WAY = f"t AS (SELECT o_orderkey, {_columns('o_orderkey', **WAY)} FROM orders), w AS (SELECT *, CASE WHEN oneway = 'yes' THEN 1 WHEN oneway = '-1' THEN -1 WHEN oneway = 'no' THEN 0 WHEN highway = 'motorway' THEN 1 ELSE 0 END AS dir, CASE WHEN lanes = '2' THEN 2 WHEN lanes = '20' THEN 20 END AS total, CAST(lanes__forward AS INTEGER) AS f, CAST(lanes__backward AS INTEGER) AS b FROM t), l AS (SELECT *, coalesce(total, f + b, CASE WHEN dir <> 0 THEN coalesce(f, b) END) AS found FROM w), n AS (SELECT *, CASE WHEN found <= 16 THEN found END AS n FROM l)"


@query("prj20_lanes", f"WITH {_WAY} SELECT o_orderkey, dir, n AS lanes FROM n")
def _(spark, d):
    tags = _tags(F.col("o_orderkey"), **WAY)
    return table(spark, d, "orders").select("o_orderkey", R.oneway(tags).alias("dir"), R.lanes(tags).alias("lanes"))


@query("prj19_width", f"WITH {_WAY} SELECT o_orderkey, coalesce(CASE width WHEN '7.5' THEN 7.5 WHEN '6 m' THEN 6.0 END::DOUBLE, round(n * 3.25::DOUBLE + 0.5, 2), CASE highway WHEN 'motorway' THEN 12.0 WHEN 'primary' THEN 9.0 END::DOUBLE, 8.0::DOUBLE) AS metres, CASE WHEN width IN ('7.5', '6 m') THEN 'tag' WHEN n IS NOT NULL THEN 'lanes' ELSE 'class' END AS basis FROM n")
def _(spark, d):
    metres, basis = R.width(_tags(F.col("o_orderkey"), **WAY), {"motorway": 12.0, "primary": 9.0})
    return table(spark, d, "orders").select("o_orderkey", metres.alias("metres"), basis.alias("basis"))


SURFACE = ["asphalt", "sett", "mud", "moon", None]


@query("prj18_surface", f"SELECT o_orderkey, CASE {_sql(SURFACE, 'o_orderkey')} WHEN 'sett' THEN 'concrete' WHEN 'mud' THEN 'dirt' ELSE 'asphalt' END AS surface FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.surface(_pick(SURFACE, F.col("o_orderkey"))).alias("surface"))


SPEED = ["50", "KR:urban", "60 km/h", "5", "mph 30", " 80km/h ", None, "none"]


@query("prj10_speed", f"SELECT o_orderkey, CASE {_sql(SPEED, 'o_orderkey')} WHEN '50' THEN 50 WHEN 'KR:urban' THEN 50 WHEN '60 km/h' THEN 60 WHEN ' 80km/h ' THEN 80 END AS kmh FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.speed_kmh(_pick(SPEED, F.col("o_orderkey"))).alias("kmh"))


METRES = ["12", "3.5 m", "0", "1000.5", "-2", "7m", None]


@query("prj11_metres", f"SELECT o_orderkey, CASE {_sql(METRES, 'o_orderkey')} WHEN '12' THEN 12.0 WHEN '3.5 m' THEN 3.5 END::DOUBLE AS metres FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.metres(_pick(METRES, F.col("o_orderkey"))).alias("metres"))


BAR = {"barrier": ["hedge", "wall", "fence", "guard_rail"], "height": [None, "1.8 m", "tall"]}


@query("prj13_barrier", f"WITH t AS (SELECT o_orderkey, {_columns('o_orderkey', **BAR)} FROM orders) SELECT o_orderkey, CASE barrier WHEN 'hedge' THEN 'hedge' WHEN 'wall' THEN 'wall' ELSE 'fence' END AS kind, CASE WHEN barrier = 'fence' AND height = '1.8 m' THEN 1.8 WHEN barrier IN ('hedge', 'guard_rail') THEN 0.8 WHEN barrier = 'wall' THEN 2.0 ELSE 1.2 END::DOUBLE AS height, CASE barrier WHEN 'hedge' THEN 0.6 WHEN 'wall' THEN 0.3 ELSE 0.1 END::DOUBLE AS thickness FROM t")
def _(spark, d):
    kind, height, thickness = R.barrier(_tags(F.col("o_orderkey"), **BAR))
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), height.alias("height"), thickness.alias("thickness"))


GROUND = {"amenity": [None, "parking", "school"], "parking": [None, "rooftop"], "surface": [None, None, "gravel"], "landuse": [None, "meadow", "retail"], "bridge": [None, None, "no", "yes"]}


@query("prj12_ground", f"WITH t AS (SELECT o_orderkey, {_columns('o_orderkey', **GROUND)} FROM orders) SELECT o_orderkey, CASE WHEN bridge = 'yes' THEN NULL WHEN amenity = 'parking' AND parking IS NULL THEN 'parking' WHEN surface IS NOT NULL THEN 'explicit' WHEN landuse = 'meadow' THEN 'green' END AS kind FROM t")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.ground(_tags(F.col("o_orderkey"), **GROUND))[0].alias("kind"))


WALK = {"sidewalk": [None, "both", "none", "separate"], "sidewalk__left": [None, "yes", "no"], "sidewalk__right": [None, "no"]}


@query("prj23_sidewalk", f"WITH t AS (SELECT o_orderkey, {_columns('o_orderkey', **WALK)} FROM orders) SELECT o_orderkey, CASE WHEN sidewalk = 'none' OR (sidewalk__left = 'no' AND sidewalk__right = 'no') THEN 'no' WHEN sidewalk = 'separate' THEN 'separate' WHEN sidewalk = 'both' OR sidewalk__left = 'yes' THEN 'yes' END AS state FROM t")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.sidewalk_state(_tags(F.col("o_orderkey"), **WALK)).alias("state"))


ZONE = {"landuse": ["forest", "grass", None, "orchard"], "leisure": ["park", None]}


@query("prj25_zone", f"WITH t AS (SELECT p_partkey, p_size * 20 AS area, {_columns('p_partkey', **ZONE)} FROM part), k AS (SELECT *, coalesce(landuse, leisure) AS use FROM t), z AS (SELECT *, CASE WHEN use IN ('forest', 'orchard') THEN 'forest' WHEN use = 'park' THEN 'park' WHEN use = 'grass' AND area >= 300 THEN 'lawn' END AS kind FROM k) SELECT p_partkey, kind, CASE kind WHEN 'forest' THEN 500 WHEN 'park' THEN 700 WHEN 'lawn' THEN 900 END AS spacing FROM z")
def _(spark, d):
    kind, spacing, _ = R.zone(_tags(F.col("p_partkey"), **ZONE), F.col("p_size") * 20)
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), spacing.alias("spacing"))


GATE = {"barrier": ["gate", "stile", "wall", None], "width": [None, "2.2", "odd"]}


@query("prj14_gates", f"WITH t AS (SELECT p_partkey, {_columns('p_partkey', **GATE)} FROM part) SELECT p_partkey, CASE WHEN barrier IN ('gate', 'stile') AND width = '2.2' THEN 2.2 WHEN barrier = 'gate' THEN 3.0 WHEN barrier = 'stile' THEN 1.5 END::DOUBLE AS width FROM t")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", R.gate_width(_tags(F.col("p_partkey"), **GATE)).alias("width"))


@query("prj36_style_id", "SELECT p_partkey, concat_ws('/', lower(p_type), p_brand, CAST(p_size AS VARCHAR)) AS style FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", R.style_id(F.lower("p_type"), F.col("p_brand"), F.col("p_size").cast("string")).alias("style"))


USES, SETTLEMENTS = ("detached", "farmhouse", "office", "utility", "shop", "apartment"), ("urban", "rural", "village", "sparse", "wilderness")


@query("prj38_profile_height", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) AND o_orderkey % 5 > 0 THEN 5 ELSE [6, 6, 12, 3, 6, 12][CAST(o_orderkey % 6 AS INT) + 1] END AS height FROM orders")
def _(spark, d):
    k = F.col("o_orderkey").cast("int")
    kind, settlement = (F.get(F.array(*map(F.lit, values)), k % len(values)) for values in (USES, SETTLEMENTS))
    return table(spark, d, "orders").select("o_orderkey", R.profile_height(kind, settlement).alias("height"))
