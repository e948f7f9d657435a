"""Queries over looks, identities, extents, sets, places and spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geodesic as G
from geoloom.functions import geometry as M
from geoloom.functions import records as R
from geoloom.functions import styles as Y
from geoloom.functions.geometry import utm
from geoloom.operators import fusion as U
from geoloom.operators import places as L
from geoloom.operators import spatial as P
from geoloom.operators.sequences import segments
from geoloom.plans.base import BOXES, HOMES, SHOPS, box_edges, boxes, homes, query, shops, table
from geoloom.plans.classes import _columns, _tags
from geoloom.plans.fused import OVER, PLOTS, SITES, plots, sites

MIXED = "(CAST(o_orderkey AS BIGINT) * 48271 % 2147483647)"


def _made(spark, d, values: dict):
    key = (F.col("o_orderkey").cast("bigint") * 48271) % 2147483647
    return table(spark, d, "orders").select("o_orderkey", _tags(key, **values).alias("tags"))


def _t(values: dict) -> str:
    return f"t AS (SELECT o_orderkey, {_columns(MIXED, **values)} FROM orders)"


def _shown(tags):
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def _pairs(values, *dropped: tuple[str, str]) -> str:
    parts = [f"CASE WHEN NOT coalesce({dict(dropped).get(k, 'false')}, false) THEN '{k.replace('__', ':')}=' || {k} END" for k in sorted(values, key=lambda k: k.replace("__", ":"))]
    return f"concat_ws(';', {', '.join(parts)})"


def _case(table_: dict, value: str) -> str:
    return f"CASE {value} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in table_.items() if v is not None)} END"


def _in(value: str, items) -> str:
    return f"coalesce({value} IN ({', '.join(map(repr, items))}), false)"


@query("prj03_env_covers", f"WITH {HOMES} SELECT id, x % 50 <= y % 40 AND y % 50 <= x % 40 AND 100 + x % 70 >= 90 + y % 80 AND 100 + y % 70 >= 90 + x % 80 AS covers FROM homes")
def _(spark, d):
    x, y = F.col("x"), F.col("y")
    return homes(spark, d).select("id", Y.env_covers([x % 50, y % 50, 100 + x % 70, 100 + y % 70], [y % 40, x % 40, 90 + y % 80, 90 + x % 80]).alias("covers"))


POTENTIAL = {"highway": [None, "", None, "path"], "building": [None, "no", None, "yes"], "landuse": [None, None, "", "farm"], "waterway": [None, "river", "dam"], "type": ["multipolygon", None], "leisure": [None, "pitch", "park", None], "barrier": [None, None, "wall"]}
_POTENTIAL = f"WITH {_t(POTENTIAL)}, k AS (SELECT *, coalesce(highway <> '', false) OR coalesce(building <> 'no', false) OR coalesce(landuse <> '', false) OR coalesce(leisure = 'park', false) AS plain, {_in('leisure', ['park', 'pitch'])} AS area FROM t)"


@query("prj04_potential", f"{_POTENTIAL} SELECT o_orderkey, plain, plain OR area OR coalesce(barrier = 'wall', false) OR coalesce(waterway = 'river', false) AS city, plain OR (type IS NOT NULL AND area) AS relation FROM k")
def _(spark, d):
    t = F.col("tags")
    return _made(spark, d, POTENTIAL).select("o_orderkey", Y.potential(t).alias("plain"), Y.potential(t, city=True).alias("city"), Y.potential(t, city=True, relation=True).alias("relation"))


POINT = {"railway": [None, None, "halt", None], "highway": [None, "bus_stop", None, None], "tourism": [None, None, "museum", "hotel"], "amenity": [None, "fuel", "school", "cafe"], "shop": [None, "mall", None, "bakery"], "natural": [None, "tree"], "name": [None, "Park", " ", "Mill "], "name__ko": [None, "", None, "Na"], "genus": [None, "Pinus", "Acer"]}
_RULES = [(f"{_in(k, vs)}" if vs else f"coalesce({k} <> '', false)", kind, cat, w) for k, vs, kind, cat, w in Y.CITY_POINTS if k in POINT]
_RULES = [(c.replace("natural", '"natural"'), *x) for c, *x in _RULES]


@query("prj08_city_points", f"WITH {_t(POINT)}, n AS (SELECT *, substr(trim(coalesce(nullif(name__ko, ''), name, '')), 1, 256) AS shown, CASE {' '.join(f'WHEN {c} THEN {i}' for i, (c, *_) in enumerate(_RULES))} END AS r FROM t), f AS (SELECT *, CASE r {' '.join(f'WHEN {i} THEN {x[1]!r}' for i, x in enumerate(_RULES))} END AS kind, CASE r {' '.join(f'WHEN {i} THEN {x[2]!r}' for i, x in enumerate(_RULES))} END AS cat, CASE r {' '.join(f'WHEN {i} THEN {x[3]}' for i, x in enumerate(_RULES))} END AS weight FROM n) SELECT o_orderkey, kind, CASE WHEN kind = 'tree' AND genus = 'Pinus' THEN 'pine' ELSE cat END AS category, weight, shown AS name FROM f WHERE kind IS NOT NULL AND NOT (kind = 'poi' AND shown = '')".replace("AS natural", 'AS "natural"'))
def _(spark, d):
    return _made(spark, d, POINT).select("o_orderkey", Y.city_point(F.col("tags")).alias("p")).where("p IS NOT NULL").select("o_orderkey", "p.*")


REGION = {"landuse": [None, "", None, "farm"], "natural": [None, "wood", "water", None], "leisure": [None, "nature_reserve", None, "park"], "amenity": [None, "school", "cafe", "parking"], "boundary": [None, "protected_area", "x"], "access": [None, "no", "yes", "private"], "name": ["a", None]}


@query("prj15_regions", f"WITH {_t(REGION)} SELECT o_orderkey, coalesce(nullif(landuse, ''), CASE WHEN \"natural\" = 'wood' THEN 'forest' ELSE \"natural\" END, leisure, amenity, 'unknown') AS landuse, coalesce(boundary = 'protected_area', false) OR coalesce(leisure = 'nature_reserve', false) OR {_in('access', ['no', 'private'])} AS protected, {_pairs(REGION, ('name', 'true'), ('amenity', chr(97) + 'menity NOT IN (' + repr('school') + ', ' + repr('parking') + ')'))} AS kept FROM t".replace("AS natural", 'AS "natural"').replace("|| natural", '|| "natural"'))
def _(spark, d):
    return _made(spark, d, REGION).select("o_orderkey", Y.region_properties(F.col("tags"), city=True).alias("r")).select("o_orderkey", "r.landuse", "r.protected", _shown(F.col("r.region_tags")).alias("kept"))


CLEAN = {"highway": [None, "steps", "path", "primary"], "bridge": [None, "no", "yes", None], "incline": [None, "up"], "ele": [None, "12"], "building": [None, "roof", "yes", "no"], "layer": [None, "1", "0", "-1"], "barrier": [None, None, "wall"], "entrance": [None, "main"], "level": [None, "2"], "conveying": [None, "no", "yes"]}
_STRUCT = "(coalesce(bridge NOT IN ('no', '0'), false) OR coalesce(layer, '0') <> '0')"


@query("prj16_clean_tags", f"WITH {_t(CLEAN)}, s AS (SELECT *, {_STRUCT} AS st FROM t) SELECT o_orderkey, {_pairs(CLEAN, ('incline', _in('highway', ['steps', 'path']) + ' AND NOT st'))} AS walking, {_pairs(CLEAN, ('ele', 'highway IS NULL AND NOT st'))} AS ground, {_pairs(CLEAN, ('layer', chr(98) + 'uilding = ' + repr('yes') + ' AND barrier IS NULL AND layer = ' + repr('1')))} AS building, {_pairs(CLEAN, ('level', 'entrance IS NOT NULL'))} AS node, highway = 'steps' AND (st OR coalesce(conveying = 'yes', false)) IS TRUE AS refused FROM s".replace("highway = 'steps' AND (st OR coalesce(conveying = 'yes', false)) IS TRUE AS refused", "coalesce(highway = 'steps' AND (st OR coalesce(conveying = 'yes', false)), false) AS refused"))
def _(spark, d):
    t = F.col("tags")
    return _made(spark, d, CLEAN).select("o_orderkey", _shown(Y.walking_tags(t)).alias("walking"), _shown(Y.ground_tags(t)).alias("ground"), _shown(Y.building_tags(t)).alias("building"), _shown(Y.node_tags(t)).alias("node"), Y.steps_fault(t).isNotNull().alias("refused"))


ROAD = {"kind": ["residential", "primary", "unclassified", "footway"], "n": [None, "3", "4", "17"], "way": ["two", "one"], "surface": ["asphalt", "gravel", "concrete"], "deck": ["no", "yes"]}
_MARKED = {k: v for k, v in Y.MARKED.items() if v}


@query("prj24_markings", f"WITH {_t(ROAD)}, c AS (SELECT *, coalesce(CAST(n AS INTEGER), {_case(_MARKED, 'kind')}) AS c FROM t) SELECT o_orderkey, c AS lanes, way = 'two' AND c % 2 = 0 AS center_line, kind = 'primary' OR deck = 'yes' AS edge_lines FROM c WHERE {_in('kind', Y.MARKED)} AND surface <> 'gravel' AND c BETWEEN 1 AND 16 AND NOT (kind = 'residential' AND way = 'one')")
def _(spark, d):
    t = lambda k: F.try_element_at("tags", F.lit(k))
    m = Y.markings(t("kind"), t("n").cast("int"), t("way") == "two", t("surface"), t("deck") == "yes")
    return _made(spark, d, ROAD).select("o_orderkey", m.alias("m")).where("m IS NOT NULL").select("o_orderkey", "m.*")


HOUSE = {"building": ["yes", "apartments", "residential", "barn"], "also": ["yes", "school", "house", "garage"], "amenity": [None, None, None, "clinic"], "shop": [None, None, "x", None], "site": [None, "retail", "residential", "industrial"], "settlement": ["rural", "city", "industrial"], "flats": [None, None, None, "4"]}
_HEIGHT = f"{MIXED} % 50"
_VALUE = "CASE WHEN o_orderkey % 2 = 0 THEN building ELSE also END"


@query("prj26_facade", f"WITH {_t(HOUSE)}, v AS (SELECT *, {_VALUE} AS v, o_orderkey % 30 AS h FROM t), f AS (SELECT *, CASE WHEN v = 'yes' THEN site WHEN v = 'residential' THEN v END AS around FROM v), r AS (SELECT *, CASE WHEN v = 'school' OR amenity = 'clinic' THEN 'concrete public' WHEN v = 'apartments' OR flats = '4' THEN 'concrete residential' WHEN v = 'house' THEN 'brick residential' WHEN shop = 'x' THEN 'concrete commercial' WHEN v = 'barn' THEN 'wood industrial' WHEN v = 'garage' THEN 'concrete industrial' WHEN around = 'retail' THEN 'concrete commercial' WHEN around = 'industrial' THEN 'concrete industrial' WHEN around = 'residential' AND h > 0 AND h < 12 THEN 'brick residential' ELSE 'concrete residential' END AS k FROM f) SELECT o_orderkey, split_part(k, ' ', 1) AS material, split_part(k, ' ', 2) AS usage, v <> 'residential' AS inferred FROM r")
def _(spark, d):
    t = lambda k: F.try_element_at("tags", F.lit(k))
    value = F.when(F.col("o_orderkey") % 2 == 0, t("building")).otherwise(t("also"))
    material, usage, inferred = Y.facade(value, t("amenity"), F.col("o_orderkey") % 30, t("site"), t("flats") == "4", t("shop"))
    return _made(spark, d, HOUSE).select("o_orderkey", material.alias("material"), usage.alias("usage"), inferred.alias("inferred"))


@query("prj27_building_type", f"WITH {_t(HOUSE)}, k AS (SELECT *, coalesce({_case(Y.AMENITY_TYPES, 'amenity')}, {_case(Y.BUILDING_TYPES, 'building')}) AS k, o_orderkey % 60 AS h, o_orderkey % 500 AS a FROM t) SELECT o_orderkey, CASE WHEN k IS NOT NULL THEN CASE WHEN shop = 'x' AND k IN ('lowrise', 'apartment') THEN 'mixed_use' WHEN k = 'apartment' AND h >= 40 THEN 'residential_tower' ELSE k END WHEN shop = 'x' THEN 'shop' WHEN settlement = 'rural' THEN CASE WHEN a < 300 THEN 'detached' ELSE 'warehouse' END WHEN settlement = 'industrial' THEN 'utility' ELSE 'lowrise' END AS type, CASE WHEN amenity IS NOT NULL THEN 'source:amenity' WHEN k IS NOT NULL THEN 'source:building' WHEN shop = 'x' THEN 'source:shop' ELSE 'context:profile' END AS basis FROM k")
def _(spark, d):
    kind, basis = Y.building_type(F.col("tags"), F.col("o_orderkey") % 60, F.try_element_at("tags", F.lit("settlement")), F.col("o_orderkey") % 500)
    return _made(spark, d, HOUSE).select("o_orderkey", kind.alias("type"), basis.alias("basis"))


GROUND = {"surface": [None, None, "sett", "moon"], "natural": [None, None, "beach", "wood"], "landuse": [None, "farmland", "paddy", "meadow"], "crop": [None, "rice", "wheat"], "leisure": [None, None, "garden", "pitch"], "amenity": [None, "parking"], "highway": [None, "steps", "primary"]}


@query("prj28_ground_style", f"WITH {_t(GROUND)}, p AS (SELECT *, coalesce(landuse = 'paddy' OR (landuse = 'farmland' AND crop = 'rice'), false) AS paddy FROM t) SELECT o_orderkey, CASE WHEN surface = 'sett' THEN 'stone_paving' WHEN \"natural\" = 'beach' THEN 'sand' WHEN \"natural\" = 'wood' THEN 'forest_floor' WHEN paddy THEN 'paddy' WHEN landuse = 'farmland' THEN 'cropland' WHEN landuse = 'meadow' THEN 'grassland' WHEN leisure = 'garden' THEN 'managed_lawn' WHEN amenity = 'parking' THEN 'asphalt' WHEN highway = 'steps' THEN 'pavers' END AS style, CASE WHEN surface = 'sett' THEN 'source:surface' WHEN \"natural\" IS NOT NULL THEN 'source:natural' WHEN landuse IS NOT NULL THEN 'source:landuse' WHEN leisure = 'garden' THEN 'source:leisure' WHEN amenity = 'parking' THEN 'context:parking' WHEN highway = 'steps' THEN 'context:walking' END AS basis FROM p".replace("AS natural", 'AS "natural"'))
def _(spark, d):
    style, basis = Y.ground_style(F.col("tags"))
    return _made(spark, d, GROUND).select("o_orderkey", style.alias("style"), basis.alias("basis"))


ROOF = {"author": [None, None, None, "dome"], "shape": [None, "gable", "blob", "dome"], "aux": [None, "round"], "material": [None, "tiles", "mud", "slate"], "colour": [None, "Blue", "red"], "holy": ["yes", "no"]}


@query("prj29_roof_style", f"WITH {_t(ROOF)}, r AS (SELECT *, coalesce(author, shape, aux) AS raw, {_case({'gable': 'gabled', 'round': 'vault', 'dome': 'dome'}, 'coalesce(author, shape, aux)')} AS s, {_case({'tiles': 'clay_tile', 'slate': 'dark_tile'}, 'material')} AS m FROM t), b AS (SELECT *, coalesce(holy = 'yes' AND s = 'dome' AND colour = 'Blue', false) AS blue FROM r) SELECT o_orderkey, coalesce(s, 'flat') AS shape, CASE WHEN blue THEN 'blue_tile' ELSE coalesce(m, 'plaster') END AS material, CASE WHEN s IS NULL THEN 'context:profile' WHEN author IS NOT NULL THEN 'author' WHEN shape IS NOT NULL THEN 'source:roof' ELSE 'auxiliary:roof' END AS shape_basis, CASE WHEN blue THEN 'source:roof_color' WHEN m IS NULL THEN 'context:profile' ELSE 'source:roof' END AS material_basis FROM b")
def _(spark, d):
    t, none = (lambda k: F.try_element_at("tags", F.lit(k))), F.lit(None).cast("string")
    r = Y.roof_style((t("author"), none), (t("shape"), t("material")), (t("aux"), none), (F.lit("flat"), F.lit("plaster")), t("colour"), t("holy") == "yes", ["gabled", "hipped", "vault", "dome", "flat"], ["clay_tile", "dark_tile", "metal", "plaster", "blue_tile"])
    return _made(spark, d, ROOF).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.shape", "r.material", "r.shape_basis", "r.material_basis")


AXES = {"climate": [None, "arid", "moon"], "terrain": [None, "canyon", "plain"], "depth": [None, None, None, "deep"]}


@query("prj31_merged_profile", f"WITH {_t(AXES)} SELECT o_orderkey, concat_ws(';', 'climate=' || coalesce(climate, 'temperate'), 'depth=' || depth, 'settlement=city', 'terrain=' || coalesce(terrain, 'plain')) AS profile, CASE WHEN depth IS NOT NULL THEN 'unknown axis' WHEN climate = 'moon' THEN 'unknown option' END AS fault FROM t")
def _(spark, d):
    base = F.create_map(*map(F.lit, ("climate", "temperate", "settlement", "city", "terrain", "plain")))
    merged, fault = Y.merge_profile(base, F.col("tags"), {"climate": ["arid", "temperate"], "settlement": ["city"], "terrain": ["canyon", "plain"]})
    return _made(spark, d, AXES).select("o_orderkey", _shown(merged).alias("profile"), fault.alias("fault"))


@query("prj34_faults", "SELECT p_partkey, CASE WHEN p_retailprice NOT BETWEEN 950 AND 1500 THEN 'out of range' END AS number, CASE WHEN length(p_name) > 30 THEN 'too long' END AS text, CASE WHEN p_partkey % 5 = 0 THEN 'control character' WHEN p_partkey % 7 = 0 THEN 'empty' END AS other FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    other = F.when(k % 5 == 0, F.concat(F.lit("a"), F.chr(F.lit(7)))).when(k % 7 == 0, " ").otherwise("fine")
    return table(spark, d, "part").select("p_partkey", Y.number_fault(F.col("p_retailprice"), 950, 1500).alias("number"), Y.text_fault(F.col("p_name"), 30).alias("text"), Y.text_fault(other).alias("other"))


WATER = {"ford": [None, "no", "yes", None], "highway": ["path", "ford", "primary", "primary"], "tunnel": [None, "no", "culvert"], "man_made": [None, None, "dyke"]}


@query("prj37_water_exceptions", f"WITH {_t(WATER)}, f AS (SELECT *, coalesce(ford = 'yes', false) OR highway = 'ford' AS own FROM t), n AS (SELECT l_orderkey, bool_or(l_partkey % 11 = 0) AS wet FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, own OR coalesce(wet, false) AS ford, own OR coalesce(wet, false) OR coalesce(tunnel = 'culvert', false) OR coalesce(man_made = 'dyke', false) AS excluded FROM f LEFT JOIN n ON l_orderkey = o_orderkey")
def _(spark, d):
    nodes = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 11 == 0, F.create_map(F.lit("ford"), F.lit("yes"))).alias("node"))
    wet = nodes.groupBy("l_orderkey").agg(F.max(Y.ford(F.col("node"))).alias("wet"))
    both = _made(spark, d, WATER).join(wet, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    some = F.coalesce("wet", F.lit(False))
    return both.select("o_orderkey", (Y.ford(F.col("tags")) | some).alias("ford"), (Y.not_over_water(F.col("tags")) | some).alias("excluded"))


@query("prj40_extent_load", "WITH e AS (SELECT c_custkey, c_custkey % 40 / 10.0 + 0.1 AS r, c_custkey % 2 = 0 AS sq FROM customer), a AS (SELECT *, CASE WHEN sq THEN 4.0 * r * r ELSE pi() * r * r END AS area, CASE WHEN sq THEN r * 2000.0 ELSE r * 2020.0 END AS side FROM e) SELECT c_custkey, round(area, 6) AS area_km2, CAST(ceil(side / 15.0 - 0.000000001) * ceil(side / 15.0 - 0.000000001) AS BIGINT) AS cells, round(area / 12.566 * 7, 6) AS minutes_low, round(area / 12.566 * 5, 6) AS mb_high, CASE WHEN area / 12.566 > 1.01 THEN 'high' ELSE 'normal' END AS level FROM a")
def _(spark, d):
    k = F.col("c_custkey")
    e = Y.estimate_extent((k % 40 / 10.0 + 0.1), k % 2 == 0, F.lit(0.0), 3, 500)
    return table(spark, d, "customer").select("c_custkey", e.alias("e")).select("c_custkey", F.round("e.area_km2", 6).alias("area_km2"), F.col("e.cells").cast("bigint").alias("cells"), F.round("e.minutes_low", 6).alias("minutes_low"), F.round("e.mb_high", 6).alias("mb_high"), "e.level")


LAND = {"amenity": [None, "clinic", "townhall", "cafe"], "name": [None, "Hall"]}


@query("prj41_landmarks", f"WITH {_t(LAND)} SELECT o_orderkey, CASE amenity WHEN 'clinic' THEN 'hospital' WHEN 'townhall' THEN 'public' ELSE 'landmark' END AS category, CASE amenity WHEN 'clinic' THEN 3 WHEN 'townhall' THEN 6 WHEN 'cafe' THEN 1 ELSE 6 END AS weight FROM t WHERE name IS NOT NULL")
def _(spark, d):
    category, weight = Y.landmark(F.try_element_at("tags", F.lit("amenity")))
    return _made(spark, d, LAND).where(Y.display_name(F.col("tags")) != "").select("o_orderkey", category.alias("category"), weight.alias("weight"))


@query("cel02_cover_style", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 11 = 5 THEN 'sand' ELSE ['forest_floor', 'scrub', 'grassland', 'cropland', 'pavers', 'rock', 'snow', NULL, 'wetland', 'scrub', NULL][p_partkey % 11 + 1] END AS style FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", Y.cover_style((k % 11 * 10 + 10).cast("int"), F.lit("plain"), F.when(k % 2 == 0, "arid").otherwise("cold")).alias("style"))


@query("sca04_geodesics", "SELECT c_custkey, CAST(c_custkey % 997 * 1000 + 10 AS DOUBLE) AS metres, CAST(c_custkey % 360 AS DOUBLE) AS azimuth FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    start = [(k * 7 % 340 - 170).cast("double"), (k * 11 % 130 - 65).cast("double")]
    end = table(spark, d, "customer").select("c_custkey", start[0].alias("lon"), start[1].alias("lat"), G.forward(*start, (k % 360).cast("double"), (k % 997 * 1000 + 10).cast("double")).alias("e"))
    back = end.select("c_custkey", G.inverse("lon", "lat", "e.lon", "e.lat").alias("b"))
    return back.select("c_custkey", F.round("b.metres", 3).alias("metres"), (F.round("b.azimuth", 2) % 360).alias("azimuth"))


@query("sca05_disks", "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(least(512, greatest(64, ceil(pi() / acos(1 - least(0.25 / (s_suppkey % 200 * 100 + 50), 0.5))))) AS BIGINT) AS vertices, true AS round FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey").cast("bigint")
    centres = table(spark, d, "supplier").select(k.alias("id"), (k * 7 % 340 - 170).cast("double").alias("lon"), (k * 11 % 130 - 65).cast("double").alias("lat"), (k % 200 * 100 + 50).alias("metres"))
    ring = P.grown(G.disk(centres)).withColumnsRenamed({"lon": "x", "lat": "y"}).join(centres, "id")
    off = F.abs(G.inverse("lon", "lat", "x", "y")["metres"] - F.col("metres"))
    return ring.select("id", off.alias("off")).groupBy("id").agg(F.count(F.lit(1)).alias("vertices"), (F.max("off") < 0.001).alias("round"))


@query("sca05_squares", "SELECT CAST(s_suppkey AS BIGINT) AS id, 4 * CAST(ceil((s_suppkey % 50 * 20 + 30) / 12.5) AS BIGINT) AS vertices, true AS straight FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey").cast("bigint")
    centres = table(spark, d, "supplier").select(k.alias("id"), (12.5 + k % 9 * 0.2).alias("lon"), (56.0 + k % 7 * 0.3).alias("lat"), (k % 50 * 20 + 30).alias("half"))
    ring = P.grown(G.square(centres, 12.0)).withColumnsRenamed({"lon": "x", "lat": "y"}).join(centres, "id")
    a, b = utm(F.col("lon"), F.col("lat"), 12.0), utm(F.col("x"), F.col("y"), 12.0)
    far = F.greatest(F.abs(b[0] - a[0]), F.abs(b[1] - a[1]))
    return ring.select("id", F.abs(far - F.col("half")).alias("off")).groupBy("id").agg(F.count(F.lit(1)).alias("vertices"), (F.max("off") < 0.001).alias("straight"))


@query("sca14_canonical_json", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}') AS digest FROM part""")
def _(spark, d):
    fields = F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    return table(spark, d, "part").select("p_partkey", R.digest(R.canonical_json(fields)).alias("digest"))


@query("sca15_stable_ids", "SELECT l_orderkey, l_linenumber, 'way-' || l_orderkey || '-' || l_linenumber || '-' || substr(sha256('way-' || l_orderkey || '-' || l_linenumber), 1, 12) AS id FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.stable_id(F.lit("way"), F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))


@query("sca20_countries", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 1, 2) WHEN n_nationkey % 3 = 1 THEN substr(n_name, 2, 2) END AS code, CASE n_nationkey % 3 WHEN 0 THEN 'boundary' WHEN 1 THEN 'subdivision' END AS basis FROM nation")
def _(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    code, basis = R.iso_country(F.when(k % 3 == 0, "2").otherwise("4"), F.when(k % 2 == 0, ""), F.substring(name, 1, 2), F.when(k % 3 == 1, F.concat(F.substring(name, 2, 2), F.lit("-7"))))
    return table(spark, d, "nation").select("n_nationkey", code.alias("code"), basis.alias("basis"))


@query("sca21_normalised", """SELECT p_partkey, '{' || concat_ws(',', CASE WHEN p_partkey % 3 > 0 THEN '"name":"' || p_brand || '"' END, '"size":' || p_size, '"step":' || CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '1.5' END, CASE WHEN p_partkey % 4 > 0 THEN '"yaw":' || p_partkey % 4 END) || '}' AS record FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    record = R.normalised_record({"name": F.when(k % 3 > 0, F.col("p_brand"))}, {"yaw": (k % 4).cast("double"), "step": F.when(k % 2 == 0, 1.0).otherwise(1.5), "size": F.col("p_size").cast("double")}, ("yaw",))
    return table(spark, d, "part").select("p_partkey", record.alias("record"))


@query("sca16_segment_gaps", "WITH s AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 100 AS DOUBLE) AS h FROM customer) SELECT id, CASE WHEN h BETWEEN 30 AND 60 THEN CASE WHEN h = 30 OR h = 60 THEN 0.0 ELSE 0.0 END WHEN h < 30 THEN (30 - h) * (30 - h) ELSE (h - 60) * (h - 60) END AS gap2 FROM s")
def _(spark, d):
    h, at = (F.col("c_custkey") * 7 % 100).cast("double"), F.lit
    gap = M.segment_gap2(at(0.0), h, at(100.0), h, at(50.0), at(30.0), at(50.0), at(60.0))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), gap.alias("gap2"))


@query("set01_either", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_custkey IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    a, b = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return L.in_either(table(spark, d, "orders"), "o_custkey", a, b).select("o_orderkey")


@query("set02_insert_or_ignore", "SELECT s_suppkey AS id, 'known' AS origin FROM supplier UNION ALL SELECT l_suppkey * 2, 'new' FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey")
def _(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("known").alias("origin"))
    new = table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("id"), F.lit("new").alias("origin"))
    return L.insert_or_ignore(known, new)


COVERED = f"{HOMES}, {SHOPS}, {SITES}, small AS (SELECT id, (x // 500) * 500 + 20 AS x0, (y // 500) * 500 + id % 200 AS y0, (x // 500) * 500 + 250 AS x1, (y // 500) * 500 + 300 AS y1 FROM shops)"


@query("set09_absorbed", f"WITH {COVERED} SELECT b.id, CAST(min_by(a.id, a.id - (a.x1 - a.x0) * (a.y1 - a.y0) * 1000000) AS BIGINT) AS owner FROM small b JOIN sites a ON a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 GROUP BY b.id")
def _(spark, d):
    x, y = F.floor(F.col("x") / 500) * 500, F.floor(F.col("y") / 500) * 500
    small = shops(spark, d).select("id", (x + 20).alias("x0"), (y + F.col("id") % 200).alias("y0"), (x + 250).alias("x1"), (y + 300).alias("y1"))
    return L.absorbed(sites(spark, d), small, 500)


@query("agg22_parcel_band", f"WITH {OVER}, s AS (SELECT p.id, coalesce(sum(o.c) / ((p.x1 - p.x0) * (p.y1 - p.y0)), 0) AS share FROM plots p LEFT JOIN o ON o.b = p.id GROUP BY p.id, p.x0, p.x1, p.y0, p.y1) SELECT id, round(share, 4) AS share, share BETWEEN 0.295 AND 0.555 AS fits FROM s")
def _(spark, d):
    return L.in_band(U.coverage(plots(spark, d), sites(spark, d), 500).select("id", "share"), 0.30, 0.55)


@query("agg25_grounded", "WITH g AS (SELECT vec_id AS row, unnest(range(0, 64)) AS col, unnest(embedding) AS h FROM embeddings), p AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 70 AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer) SELECT id, CAST(round(10000 * CAST(h AS DOUBLE)) AS BIGINT) AS h FROM p LEFT JOIN g ON row = y AND col = x")
def _(spark, d):
    k = F.col("c_custkey").cast("bigint")
    pts = table(spark, d, "customer").select(k.alias("id"), (k % 70).cast("double").alias("x"), k.cast("double").alias("y"))
    grid = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "h"))
    return L.ground_points(pts, grid, 0.0, 0.0, 1.0).select("id", F.round(F.col("h") * 10000).cast("bigint").alias("h"))


_PLACES = {"place": [None, "village", None, "town"], "shop": ["a", None], "amenity": [None, "", "fuel"]}


@query("top02_anchors", f"WITH {_t(_PLACES)}, p AS (SELECT o_orderkey AS id, o_orderkey % 3 AS issue, CASE place WHEN 'town' THEN 1 WHEN 'village' THEN 2 ELSE CASE WHEN amenity = 'fuel' THEN 20 ELSE 30 END END AS tier FROM t) SELECT * FROM p ORDER BY issue, tier, id LIMIT 16")
def _(spark, d):
    t = lambda k: F.try_element_at("tags", F.lit(k))
    rows = _made(spark, d, _PLACES).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("issue"), L.tier(t("place"), t("amenity"), t("tourism")).alias("tier"))
    return L.anchors(rows)


@query("top06_canonical_order", "SELECT p_brand, p_type, p_partkey FROM part ORDER BY p_brand, p_partkey, p_type LIMIT 40")
def _(spark, d):
    return L.canonical_order(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_brand").limit(40)


@query("top07_busiest", "SELECT l_suppkey AS id, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, q DESC, id LIMIT 25")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("q"))
    return L.busiest(rows, "n", "q").limit(25)


_AREAS = "areas AS (SELECT id, x0, y0, x1, y1, CASE WHEN id % 4 = 0 THEN 2 ELSE 4 END AS level, CASE WHEN id % 8 = 0 THEN 'AA' WHEN id % 4 = 0 THEN 'BB' ELSE '' END AS country, CASE WHEN id % 4 = 1 THEN 'cc-' || id ELSE '' END AS subdivision, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS km2 FROM boxes)"


@query("jon17_located", f"WITH {HOMES}, {BOXES}, {_AREAS}, h AS (SELECT h.id, a.id AS aid, level, country, subdivision, km2 FROM homes h JOIN areas a ON h.x BETWEEN a.x0 AND a.x1 AND h.y BETWEEN a.y0 AND a.y1), g AS (SELECT id, string_agg(aid::VARCHAR, ',' ORDER BY km2 DESC, aid) AS areas, arg_min(country, -km2 * 100000 + aid) FILTER (country <> '') AS own, arg_min(upper(substr(subdivision, 1, 2)), km2 * 100000 - aid) FILTER (subdivision <> '') AS part FROM h GROUP BY id) SELECT homes.id, coalesce(areas, '') AS areas, coalesce(own, part) AS code, CASE WHEN own IS NOT NULL THEN 'boundary' WHEN part IS NOT NULL THEN 'subdivision' END AS basis FROM homes LEFT JOIN g USING (id)")
def _(spark, d):
    k = F.col("id")
    areas = boxes(spark, d).select("id", F.when(k % 4 == 0, 2).otherwise(4).alias("level"), F.when(k % 8 == 0, "AA").when(k % 4 == 0, "BB").otherwise("").alias("country"), F.when(k % 4 == 1, F.concat(F.lit("cc-"), k.cast("string"))).otherwise("").alias("subdivision"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("km2"))
    found = L.located(homes(spark, d), areas, box_edges(spark, d), 500)
    return found.withColumn("areas", F.array_join(F.col("areas").cast("array<string>"), ","))


ROADS = f"{SHOPS}, roads AS (SELECT id, x, y, x + 300 + id % 200 AS x2, 40 + id % 3 * 20 AS width FROM shops)"


def _roads(starts):
    k = F.col("id")
    return starts.select("id", F.lit(0).cast("bigint").alias("seq"), "x", "y", (F.col("x") + 300 + k % 200).alias("x2"), F.col("y").alias("y2"), (40 + k % 3 * 20).alias("width"))


@query("cel04_corridors", f"WITH {ROADS}, c AS (SELECT id, x, y, x2, width / 2 + 10 AS r, unnest(range(CAST(x // 50 - 3 AS BIGINT), CAST(x2 // 50 + 4 AS BIGINT))) AS cx FROM roads), g AS (SELECT *, unnest(range(CAST(y // 50 - 3 AS BIGINT), CAST(y // 50 + 4 AS BIGINT))) AS cy FROM c) SELECT id, count(*) AS cells FROM g WHERE pow(greatest(x - (cx * 50 + 25), 0, cx * 50 + 25 - x2), 2) + pow(cy * 50 + 25 - y, 2) <= r * r GROUP BY id")
def _(spark, d):
    return P.corridor(_roads(shops(spark, d)), 50, 10).groupBy("id").agg(F.count(F.lit(1)).alias("cells"))


@query("cel03_space_share", f"WITH {ROADS}, {HOMES}, {SITES}, c AS (SELECT id, x, y, x2, width / 2 + 10 AS r, unnest(range(CAST(x // 50 - 3 AS BIGINT), CAST(x2 // 50 + 4 AS BIGINT))) AS cx FROM roads), g AS (SELECT *, unnest(range(CAST(y // 50 - 3 AS BIGINT), CAST(y // 50 + 4 AS BIGINT))) AS cy FROM c), space AS (SELECT DISTINCT cx, cy FROM g WHERE pow(greatest(x - (cx * 50 + 25), 0, cx * 50 + 25 - x2), 2) + pow(cy * 50 + 25 - y, 2) <= r * r), f AS (SELECT id, x0, x1, y0, y1, unnest(range(CAST(x0 // 50 AS BIGINT), CAST(x1 // 50 + 1 AS BIGINT))) AS cx FROM sites), o AS (SELECT *, unnest(range(CAST(y0 // 50 AS BIGINT), CAST(y1 // 50 + 1 AS BIGINT))) AS cy FROM f), k AS (SELECT id, cx, cy FROM o WHERE cx * 50 + 25 BETWEEN x0 AND x1 AND cy * 50 + 25 BETWEEN y0 AND y1) SELECT k.id, count(*) AS n, count(s.cx) AS taken FROM k LEFT JOIN space s ON s.cx = k.cx AND s.cy = k.cy GROUP BY k.id")
def _(spark, d):
    return P.space_share(sites(spark, d), P.corridor(_roads(shops(spark, d)), 50, 10), 50)


@query("jon37_zone_entries", f"WITH {HOMES}, {BOXES}, roads AS (SELECT id, x, y, x + 300 + id % 200 AS x2 FROM homes), e AS (SELECT r.id, b.id AS zone, r.y, b.x0, b.x1, r.x, r.x2 FROM roads r JOIN boxes b ON r.y > b.y0 AND r.y < b.y1) SELECT id, zone, CAST(x0 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, true AS enters FROM e WHERE x < x0 AND x0 < x2 UNION ALL SELECT id, zone, CAST(x1 AS DOUBLE), CAST(y AS DOUBLE), false FROM e WHERE x < x1 AND x1 < x2")
def _(spark, d):
    return P.zone_entries(_roads(homes(spark, d)), box_edges(spark, d), 500).select("id", "zone", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "enters")


@query("jon43_front_probes", f"WITH {ROADS}, {BOXES} SELECT id FROM roads r WHERE EXISTS (SELECT 1 FROM boxes b WHERE pow(greatest(b.x0 - x2, 0, x - b.x1), 2) + pow(greatest(b.y0 - y, 0, y - b.y1), 2) <= 900 AND NOT (x > b.x0 + 30 AND x2 < b.x1 - 30 AND y > b.y0 + 30 AND y < b.y1 - 30))")
def _(spark, d):
    return P.probes_hit(_roads(shops(spark, d)), box_edges(spark, d), 500, 30).select("id")


def _nested(spark, d):
    """Three rings in each other for every shop, in a place of its own; every fifth shop has a fourth that crosses the first."""
    k = F.col("id")
    x, y = (k % 1000) * 1000, F.floor(k / 1000) * 1000
    ring = F.explode(F.when(k % 5 == 0, F.array(*map(F.lit, (0, 1, 2, 3)))).otherwise(F.array(*map(F.lit, (0, 1, 2)))))
    rings = shops(spark, d).select(k.alias("shop"), x.alias("x"), y.alias("y"), ring.alias("r"))
    low, high = F.col("r") % 3 * 100 + F.when(F.col("r") == 3, 450).otherwise(0), 600 - F.col("r") % 3 * 100 + F.when(F.col("r") == 3, 50).otherwise(0)
    ends = [(low, low), (high, low), (high, high), (low, high)]
    corner = F.posexplode(F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ends]))
    pts = rings.select((F.col("shop") * 4 + F.col("r")).alias("id"), corner.alias("seq", "p")).select("id", "seq", "p.x", "p.y")
    return segments(pts, closed=True)


@query("gra06_grouped_rings", "WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS k, unnest(CASE WHEN s_suppkey % 5 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS r FROM supplier) SELECT k * 4 + r AS id, CAST(CASE r WHEN 3 THEN 2 ELSE r END AS BIGINT) AS depth, CASE WHEN r = 1 THEN 'hole' ELSE 'outer' END AS role, CASE WHEN r = 1 THEN k * 4 END AS parent, CASE WHEN k % 5 = 0 AND r <> 2 THEN 'crosses' END AS fault FROM r")
def _(spark, d):
    return U.group_rings(_nested(spark, d), 500)
