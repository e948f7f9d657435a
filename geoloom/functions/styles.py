"""Looks, uses and properties of tagged features by ordered rules, as column expressions.

As in ``rules``, the first rule that holds decides, and a missing tag holds no rule. Functions that
refuse a value return the reason as text, null where it is fine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.rules import BARRIERS, RURAL, SITE_AMENITY, WATERWAY_METRES, _area, either, first_of, is_in, is_structure, lookup, tag, tree_hint

# Tag names and values that decide a feature's place, look or use, in order of precedence.
CITY_POINTS = (
    ("railway", ("station", "halt"), "station", "station", 10),
    ("station", ("subway", "train", "light_rail"), "station", "station", 10),
    ("public_transport", ("station",), "station", "station", 9),
    ("railway", ("subway_entrance", "train_station_entrance"), "subway_entrance", "subway_entrance", 2),
    ("highway", ("bus_stop",), "bus_stop", "bus_stop", 1),
    ("highway", ("stop",), "stop", "stop", 0),
    ("highway", ("give_way",), "give_way", "give_way", 0),
    ("highway", ("traffic_signals",), "traffic_signals", "traffic_signals", 0),
    ("tourism", ("museum", "attraction", "viewpoint", "gallery", "zoo", "theme_park", "aquarium"), "poi", "attraction", 8),
    ("historic", None, "poi", "historic", 7),
    ("amenity", ("hospital",), "poi", "hospital", 7),
    ("amenity", ("university", "college"), "poi", "university", 7),
    ("amenity", ("townhall", "courthouse", "police", "fire_station", "post_office", "library", "community_centre"), "poi", "public", 5),
    ("amenity", ("school", "kindergarten"), "poi", "school", 4),
    ("amenity", ("marketplace",), "poi", "shopping", 6),
    ("shop", ("mall", "department_store", "supermarket"), "poi", "shopping", 6),
    ("leisure", ("stadium", "sports_centre", "water_park"), "poi", "sports", 5),
    ("leisure", ("park",), "poi", "park", 4),
    ("amenity", ("place_of_worship",), "poi", "worship", 3),
    ("tourism", ("hotel",), "poi", "hotel", 3),
    ("amenity", ("fuel",), "poi", "fuel", 2),
    ("amenity", ("restaurant", "cafe", "fast_food"), "poi", "food", 1),
    ("shop", None, "poi", "shop", 1),
    ("natural", ("tree",), "tree", "tree", 0),
)
LANDMARKS = {
    "hospital": ("hospital", 7), "clinic": ("hospital", 3), "school": ("school", 4), "kindergarten": ("school", 2), "university": ("university", 7),
    "college": ("university", 7), "townhall": ("public", 6), "police": ("public", 4), "fire_station": ("public", 4), "library": ("public", 4),
    "community_centre": ("public", 3), "place_of_worship": ("worship", 3),
}
REGION_KEYS = ("landuse", "natural", "leisure", "boundary", "access", "protect_class")
PEDESTRIAN = ("path", "footway", "cycleway", "pedestrian", "steps")
MARKED = {
    "motorway": 4, "trunk": 4, "primary": 4, "secondary": 2, "tertiary": 2, "motorway_link": 1, "trunk_link": 1, "primary_link": 1,
    "secondary_link": 1, "tertiary_link": 1, "unclassified": None, "residential": 2,
}
EDGE_LINED = ("motorway", "trunk", "primary")
PUBLIC_BUILDINGS = (
    "public", "civic", "government", "school", "university", "college", "kindergarten", "hospital", "church", "cathedral", "chapel", "mosque",
    "temple", "synagogue", "shrine", "train_station", "transportation", "fire_station", "stadium", "sports_hall", "museum", "library",
)
PUBLIC_AMENITIES = (
    "school", "university", "college", "kindergarten", "hospital", "clinic", "place_of_worship", "townhall", "police", "fire_station", "library",
    "community_centre", "public_building", "courthouse",
)
TALL_RESIDENTIAL = ("apartments", "dormitory")
HOUSES = ("house", "detached", "terrace", "semidetached_house", "bungalow", "villa", "cabin", "hut")
COMMERCIAL_BUILDINGS = ("commercial", "retail", "office", "hotel", "supermarket", "kiosk", "shop", "mall")
INDUSTRIAL_BUILDINGS = ("industrial", "warehouse", "factory", "manufacture", "service", "garage", "garages", "hangar", "greenhouse", "barn", "farm_auxiliary", "shed")
WOODEN_INDUSTRIAL = ("greenhouse", "barn", "farm_auxiliary", "shed")
HOUSE_TALL_M, TOWER_M, RURAL_HOUSE_M2 = 12.0, 40, 300
BUILDING_TYPES = {
    "house": "detached", "detached": "detached", "bungalow": "detached", "villa": "detached", "cabin": "detached", "terrace": "terraced",
    "semidetached_house": "terraced", "apartments": "apartment", "dormitory": "apartment", "residential": "lowrise", "retail": "shop", "shop": "shop",
    "kiosk": "shop", "commercial": "mixed_use", "office": "office", "hotel": "hotel", "supermarket": "shopping", "mall": "shopping", "school": "school",
    "kindergarten": "school", "university": "university", "college": "university", "hospital": "hospital", "clinic": "hospital", "public": "civic",
    "civic": "civic", "government": "civic", "library": "civic", "museum": "civic", "fire_station": "civic", "church": "religious",
    "cathedral": "religious", "chapel": "religious", "mosque": "religious", "temple": "religious", "synagogue": "religious", "shrine": "religious",
    "train_station": "station", "transportation": "station", "industrial": "factory", "factory": "factory", "manufacture": "factory",
    "warehouse": "warehouse", "hangar": "warehouse", "farm": "farmhouse", "farmhouse": "farmhouse", "barn": "barn", "cowshed": "barn", "stable": "barn",
    "farm_auxiliary": "barn", "greenhouse": "utility", "service": "utility", "shed": "utility", "garage": "utility", "garages": "utility",
    "research": "research",
}
AMENITY_TYPES = BUILDING_TYPES | {
    "place_of_worship": "religious", "townhall": "civic", "police": "civic", "courthouse": "civic", "community_centre": "civic",
    "public_building": "civic", "ranger_station": "civic", "bus_station": "station", "research_institute": "research",
}
GROUND_SURFACES = {
    "asphalt": "asphalt", "concrete": "concrete", "concrete:plates": "concrete", "paving_stones": "pavers", "sett": "stone_paving",
    "cobblestone": "stone_paving", "pebblestone": "gravel", "gravel": "gravel", "fine_gravel": "gravel", "compacted": "compacted_earth",
    "dirt": "compacted_earth", "earth": "compacted_earth", "ground": "compacted_earth", "sand": "sand", "rock": "rock", "grass": "managed_lawn",
    "grass_paver": "pavers", "snow": "snow", "ice": "ice", "brick": "brick_paving", "bricks": "brick_paving",
}
GROUND_NATURAL = {
    "bare_rock": "rock", "scree": "rock", "shingle": "rock", "sand": "sand", "beach": "sand", "scrub": "scrub", "heath": "scrub",
    "wood": "forest_floor", "wetland": "wetland", "mud": "wetland", "glacier": "ice", "grassland": "grassland",
}
GROUND_LANDUSE = {
    "forest": "forest_floor", "orchard": "orchard", "vineyard": "vineyard", "farmland": "cropland", "farmyard": "compacted_earth",
    "meadow": "grassland", "grass": "managed_lawn", "flowerbed": "managed_lawn", "recreation_ground": "managed_lawn", "village_green": "managed_lawn",
}
ROOF_SHAPES = {"gable": "gabled", "hip": "hipped", "round": "vault", "barrel": "vault", "pyramid": "pyramidal"}
ROOF_MATERIALS = {
    "roof_tiles": "clay_tile", "tiles": "clay_tile", "tile": "clay_tile", "slate": "dark_tile", "shingles": "dark_tile", "metal": "metal", "zinc": "metal",
    "copper": "metal", "steel": "metal",
}
BLUE = ("blue", "#0000ff", "#0066cc")
LAND_COVER = {10: "forest_floor", 20: "scrub", 30: "grassland", 40: "cropland", 50: "pavers", 60: "rock", 70: "snow", 80: None, 90: "wetland", 95: "wetland", 100: "scrub"}
REFERENCE_KM2, REFERENCE_MINUTES, REFERENCE_MB, METRES_PER_DEGREE = 12.566, (7.0, 32.0), (1.0, 5.0), 111_320.0


def filled(value: Column) -> Column:
    """The value, null where it is empty."""
    return F.nullif(value, F.lit(""))


def yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def without(tags: Column, key: str, test: Column) -> Column:
    """The tags, without one key where the test holds."""
    return F.when(yes(test), F.map_filter(tags, lambda k, _: k != key)).otherwise(tags)


def env_covers(outer: list[Column], inner: list[Column]) -> Column:
    """Whether the box (x0, y0, x1, y1) covers the other, sides included."""
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def potential(tags: Column, city: bool = False, relation: bool = False) -> Column:
    """Whether a feature may be of use, before it is looked at closely."""
    plain = either(
        filled(tag(tags, "highway")).isNotNull(), yes(tag(tags, "building") != "no"), tag(tags, "building:part").isNotNull(), filled(tag(tags, "landuse")).isNotNull(),
        is_in(tag(tags, "natural"), ("wood", "water", "wetland", "bare_rock", "scrub", "grassland")), is_in(tag(tags, "leisure"), ("park", "nature_reserve")),
        yes(tag(tags, "boundary") == "protected_area"),
    )
    if not city:
        return plain
    if relation:
        return plain | (yes(tag(tags, "type") == "multipolygon") & _area(tags))
    return either(plain, _area(tags), is_in(tag(tags, "barrier"), BARRIERS), is_in(tag(tags, "waterway"), WATERWAY_METRES))


def display_name(tags: Column) -> Column:
    return F.substring(F.trim(F.coalesce(filled(tag(tags, "name:ko")), tag(tags, "name"), F.lit(""))), 1, 256)


def city_point(tags: Column) -> Column:
    """struct(kind, category, weight, name) of a node on its own; null where no rule holds or a place has no name."""
    tests = [is_in(tag(tags, key), values) if values else filled(tag(tags, key)).isNotNull() for key, values, *_ in CITY_POINTS]
    rule = first_of(*[(test, i + 1) for i, test in enumerate(tests)])
    kind, category, weight = (F.element_at(F.array(*[F.lit(r[c]) for r in CITY_POINTS]), rule) for c in (2, 3, 4))
    name = display_name(tags)
    found = F.struct(kind.alias("kind"), F.when(kind == "tree", tree_hint(tags)).otherwise(category).alias("category"), weight.alias("weight"), name.alias("name"))
    return F.when(rule.isNotNull() & ~((kind == "poi") & (name == "")), found)


def landmark(amenity: Column) -> tuple[Column, Column]:
    """(category, weight) of a named landmark building by its amenity."""
    category = F.coalesce(lookup(amenity, {k: v[0] for k, v in LANDMARKS.items()}), F.lit("landmark"))
    return category, F.coalesce(lookup(amenity, {k: v[1] for k, v in LANDMARKS.items()}), F.when(filled(amenity).isNotNull(), 1).otherwise(6))


def region_properties(tags: Column, city: bool = False) -> Column:
    """struct(landuse, protected, region_tags) of a region."""
    amenity = tag(tags, "amenity")
    uses = [tag(tags, "landuse"), tag(tags, "natural"), tag(tags, "leisure"), *([amenity] if city else [])]
    uses[1] = F.when(uses[1] == "wood", "forest").otherwise(uses[1])
    protected = either(yes(tag(tags, "boundary") == "protected_area"), yes(tag(tags, "leisure") == "nature_reserve"), is_in(tag(tags, "access"), ("no", "private")))
    also = is_in(amenity, (*SITE_AMENITY, "parking")) if city else F.lit(False)
    kept = F.map_filter(tags, lambda k, _: k.isin(*REGION_KEYS) | ((k == "amenity") & also))
    return F.struct(F.coalesce(*map(filled, uses), F.lit("unknown")).alias("landuse"), protected.alias("protected"), kept.alias("region_tags"))


def walking_tags(tags: Column) -> Column:
    """The incline of a walking way on the ground is its slope, no structure: dropped."""
    return without(tags, "incline", is_in(tag(tags, "highway"), PEDESTRIAN) & ~is_structure(tags))


def steps_fault(tags: Column) -> Column:
    moving = yes(tag(tags, "conveying") != "no")
    return F.when(yes(tag(tags, "highway") == "steps") & (is_structure(tags) | moving), "steps must be stairs on the ground")


def ground_tags(tags: Column) -> Column:
    """An elevation on anything but a road or a structure is that of the ground: dropped."""
    return without(tags, "ele", tag(tags, "highway").isNull() & ~is_structure(tags))


def building_tags(tags: Column, member: Column | None = None) -> Column:
    """A building above other features stands on the ground: its positive layer is dropped."""
    value = tag(tags, "building")
    own = yes(~value.isin("no", "roof")) | (yes(member if member is not None else F.lit(False)) & value.isNull())
    return without(tags, "layer", own & tag(tags, "barrier").isNull() & tag(tags, "layer").rlike("^[1-9][0-9]*$"))


def node_tags(tags: Column) -> Column:
    """An entrance's level is a floor of its building: dropped."""
    return without(tags, "level", tag(tags, "entrance").isNotNull())


def markings(kind: Column, lanes: Column, two_way: Column, surface: Column, on_structure: Column) -> Column:
    """struct(lanes, center_line, edge_lines) of painted roads, else null."""
    count = F.coalesce(F.when(lanes != 0, lanes), lookup(kind, {k: v for k, v in MARKED.items() if v}))
    painted = is_in(kind, MARKED) & is_in(surface, ("asphalt", "concrete")) & count.between(1, 16) & ~((kind == "residential") & ~two_way)
    return F.when(yes(painted), F.struct(count.cast("int").alias("lanes"), (two_way & (count % 2 == 0)).alias("center_line"), (kind.isin(*EDGE_LINED) | on_structure).alias("edge_lines")))


def facade(building: Column, amenity: Column, height: Column, site: Column, flats: Column, use: Column) -> tuple[Column, Column, Column]:
    """(material, use, inferred) of a building by its tags, height and the kind of site around it."""
    value = F.coalesce(filled(building), F.lit("yes"))
    around = F.when(value == "yes", site).when(value == "residential", "residential")
    rules = [
        (is_in(value, PUBLIC_BUILDINGS) | is_in(amenity, PUBLIC_AMENITIES), "concrete", "public"),
        (is_in(value, TALL_RESIDENTIAL) | yes(flats), "concrete", "residential"),
        (is_in(value, HOUSES), "brick", "residential"),
        (is_in(value, COMMERCIAL_BUILDINGS) | filled(use).isNotNull() | filled(amenity).isNotNull(), "concrete", "commercial"),
        (is_in(value, WOODEN_INDUSTRIAL), "wood", "industrial"),
        (is_in(value, INDUSTRIAL_BUILDINGS), "concrete", "industrial"),
        (is_in(around, ("commercial", "retail")), "concrete", "commercial"),
        (yes(around == "industrial"), "concrete", "industrial"),
        (is_in(around, SITE_AMENITY), "concrete", "public"),
        (yes((around == "residential") & (height > 0) & (height < HOUSE_TALL_M)), "brick", "residential"),
    ]
    pick = lambda i, other: F.coalesce(first_of(*[(r[0], r[i]) for r in rules]), F.lit(other))
    return pick(1, "concrete"), pick(2, "residential"), ~value.isin("residential", "commercial", "industrial", "public")


def building_type(tags: Column, height: Column, settlement: Column, area_m2: Column) -> tuple[Column, Column]:
    """(type, basis): by amenity, building, shop, office, hotel, industry, else by the settlement."""
    by = {"amenity": lookup(tag(tags, "amenity"), AMENITY_TYPES), "building": lookup(tag(tags, "building"), BUILDING_TYPES)}
    shop = filled(tag(tags, "shop")).isNotNull()

    def refined(kind: Column) -> Column:
        return F.when(shop & kind.isin("lowrise", "apartment"), "mixed_use").when((kind == "apartment") & (height >= TOWER_M), "residential_tower").otherwise(kind)

    rules = [(v.isNotNull(), refined(v), f"source:{k}") for k, v in by.items()]
    rules += [(shop, "shop", "source:shop"), (filled(tag(tags, "office")).isNotNull(), "office", "source:office"), (tag(tags, "tourism") == "hotel", "hotel", "source:tourism")]
    rules += [(filled(tag(tags, "industrial")).isNotNull(), "factory", "source:industrial"), (settlement.isin(*RURAL), F.when(area_m2 < RURAL_HOUSE_M2, "detached").otherwise("warehouse"), "context:profile")]
    rules += [(settlement == "industrial", "utility", "context:profile"), (F.lit(True), "lowrise", "context:profile")]
    return first_of(*[(r[0], r[1]) for r in rules]), first_of(*[(r[0], r[2]) for r in rules])


def ground_style(tags: Column) -> tuple[Column, Column]:
    """(style, basis) of a ground area; nulls where nothing tells."""
    surface, natural, use = (lookup(tag(tags, k), t) for k, t in (("surface", GROUND_SURFACES), ("natural", GROUND_NATURAL), ("landuse", GROUND_LANDUSE)))
    paddy = (tag(tags, "landuse") == "paddy") | ((tag(tags, "landuse") == "farmland") & tag(tags, "crop").isin("rice", "paddy"))
    rules = [
        (surface.isNotNull(), surface, "source:surface"), (natural.isNotNull(), natural, "source:natural"), (paddy, "paddy", "source:landuse"), (use.isNotNull(), use, "source:landuse"),
        (tag(tags, "leisure").isin("park", "garden", "golf_course"), "managed_lawn", "source:leisure"), (tag(tags, "amenity") == "parking", "asphalt", "context:parking"),
        (tag(tags, "highway").isin("pedestrian", "footway", "steps", "cycleway"), "pavers", "context:walking"),
    ]
    return first_of(*[(r[0], r[1]) for r in rules]), first_of(*[(r[0], r[2]) for r in rules])


def roof_style(author: tuple[Column, Column], source: tuple[Column, Column], auxiliary: tuple[Column, Column], profile: tuple[Column, Column], colour: Column, holy_cycladic: Column, shapes: list[str], materials: list[str]) -> Column:
    """struct(shape, material, shape_basis, material_basis, fault) of a roof.

    Each of author, source, auxiliary and profile is (shape, material); the first known value decides
    and an unknown one leaves the profile's. Blue counts for domes of holy Cycladic buildings alone.
    """
    parts = []
    for i, (known, names) in enumerate(((shapes, ROOF_SHAPES), (materials, ROOF_MATERIALS))):
        raw = F.coalesce(*[filled(x[i]) for x in (author, source, auxiliary)])
        value = F.coalesce(lookup(raw, names), raw)
        basis = F.when(author[i].isNotNull(), "author").when(filled(source[i]).isNotNull(), "source:roof").otherwise("auxiliary:roof")
        fine = is_in(value, known)
        parts.append((F.when(fine, value).otherwise(profile[i]), F.when(fine, basis).otherwise("context:profile")))
    (shape, shape_basis), (material, material_basis) = parts
    dome = yes(holy_cycladic & (shape == "dome"))
    blue = dome & is_in(F.lower(colour), BLUE) & author[1].isNull()
    material = F.when(blue, "blue_tile").otherwise(material)
    fault = F.when((material == "blue_tile") & ~dome, "blue domes are for holy Cycladic buildings")
    return F.struct(shape.alias("shape"), material.alias("material"), shape_basis.alias("shape_basis"), F.when(blue, "source:roof_color").otherwise(material_basis).alias("material_basis"), fault.alias("fault"))


def merge_profile(base: Column, override: Column, options: dict[str, list[str]]) -> tuple[Column, Column]:
    """(merged, fault): the base map with the override's axes in place of its own; unknown axes or options are a fault."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(override), k))
    unknown = F.exists(F.map_keys(override), lambda k: ~k.isin(*options))
    wrong = either(*[yes(~tag(override, axis).isin(*known)) for axis, known in options.items()])
    return F.map_concat(kept, override), F.when(unknown, "unknown axis").when(wrong, "unknown option")


def number_fault(value: Column, low: float = -100_000, high: float = 100_000) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), "no finite number").when(~value.between(low, high), "out of range")


def text_fault(value: Column, most: int = 512) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), "empty").when(F.char_length(value) > most, "too long").when(value.rlike("[\\x00-\\x1f]"), "control character")


def ford(tags: Column) -> Column:
    return yes(~tag(tags, "ford").isin("no", "0")) | yes(tag(tags, "highway") == "ford")


def not_over_water(tags: Column) -> Column:
    """Whether tags alone say that a way crosses water without a bridge."""
    tunnel, dam = (yes(~tag(tags, k).isin("no", "0")) for k in ("tunnel", "embankment"))
    return either(ford(tags), tunnel, dam, is_in(tag(tags, "man_made"), ("dyke", "embankment", "causeway")))


def cover_style(code: Column, terrain: Column, climate: Column) -> Column:
    """Style of a land-cover class, null for water; bare ground is sand where it is arid and no canyon."""
    style = lookup(code, {k: v for k, v in LAND_COVER.items() if v})
    return F.when((code == 60) & (terrain != "canyon") & (climate == "arid"), "sand").otherwise(style)


def estimate_extent(radius_km: Column, square: Column, lat: Column, scale: int, cell_cm: int) -> Column:
    """struct(area_km2, cells, minutes_low, minutes_high, mb_low, mb_high, level): load by area against a measured extent."""
    area = F.when(square, 4.0 * radius_km * radius_km).otherwise(F.pi() * radius_km * radius_km)
    side = F.when(square, radius_km * 2000.0).otherwise(radius_km * 2020.0)
    cell = cell_cm / 100.0 * scale
    half_lat = side * 0.5 / METRES_PER_DEGREE
    half_lon = half_lat / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    wide = F.ceil(2 * half_lon * METRES_PER_DEGREE * F.cos(F.radians(lat)) / cell - 1e-9)
    ratio = area / REFERENCE_KM2
    fields = {"area_km2": area, "cells": wide * F.ceil(2 * half_lat * METRES_PER_DEGREE / cell - 1e-9)}
    fields |= {f"{n}_{k}": v * ratio for n, vs in (("minutes", REFERENCE_MINUTES), ("mb", REFERENCE_MB)) for k, v in zip(("low", "high"), vs, strict=True)}
    return F.struct(*[v.alias(k) for k, v in fields.items()], F.when(ratio > 1.01, "high").otherwise("normal").alias("level"))
