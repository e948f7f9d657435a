"""Classification of tagged map features by ordered rules, as column expressions over a map of tags.

Where several rules could hold, the first in the stated order decides. A missing tag is null and holds no
rule; a null map gives null or false throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag names and values that decide a feature's class, and metric defaults.
BARRIERS = ("fence", "wall", "hedge", "retaining_wall", "guard_rail")
WATERWAY_METRES = {"river": 12.0, "canal": 8.0, "stream": 3.0, "drain": 2.0, "ditch": 1.5}
GREEN_LEISURE = ("park", "garden", "playground", "pitch")
GREEN_LANDUSE = ("grass", "meadow", "recreation_ground", "village_green", "cemetery", "farmland", "orchard", "forest")
GREEN_NATURAL = ("grassland", "scrub", "wood", "heath", "fell")
BARE_NATURAL = {"bare_rock": "gravel", "scree": "gravel", "shingle": "gravel", "sand": "dirt", "beach": "dirt", "wetland": "dirt", "mud": "dirt", "glacier": "concrete"}
SITE_AMENITY = ("school", "hospital", "university", "college")
SITE_LANDUSE = ("residential", "commercial", "retail", "industrial")
PARKING_LEVELS = ("underground", "multi-storey", "rooftop")
OFF_GROUND = ("bridge", "tunnel", "layer", "covered", "building:part", "min_height", "building:min_level", "incline", "level", "location")
SURFACES = {
    "asphalt": "asphalt", "concrete": "concrete", "dirt": "dirt", "gravel": "gravel", "grass": "grass", "paved": "asphalt", "paving_stones": "concrete", "sett": "concrete",
    "cobblestone": "concrete", "concrete:plates": "concrete", "concrete:lanes": "concrete", "compacted": "gravel", "fine_gravel": "gravel", "pebblestone": "gravel", "unpaved": "dirt",
    "ground": "dirt", "earth": "dirt", "sand": "dirt", "mud": "dirt", "rock": "gravel", "stone": "gravel", "wood": "concrete", "metal": "concrete",
}
LANE_METRES, LANE_MARGIN, MOST_LANES = 3.25, 0.5, 16
VEHICLE_GATES = ("gate", "lift_gate", "swing_gate", "sliding_gate")
PEDESTRIAN_GATES = ("entrance", "kissing_gate", "turnstile", "stile", "bollard", "cycle_barrier")
ZONES = {"scrub": (400, 500), "forest": (500, 750), "park": (700, 450), "lawn": (900, 300)}
TREE_WORDS = (("ginkgo", ("ginkgo", "은행")), ("zelkova", ("zelkova", "느티")), ("plane", ("platanus", "플라타너스", "버즘")), ("cherry", ("prunus", "cherry", "벚")), ("pine", ("pinus", "소나무", "pine")))


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def is_in(value: Column, values) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False))


def either(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def lookup(value: Column, table: dict[str, object]) -> Column:
    """The table's entry of a value, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def first_of(*rules: tuple[Column, object]) -> Column:
    """The outcome of the first rule that holds, else null."""
    out = F.lit(None)
    for test, outcome in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), outcome).otherwise(out)
    return out


def off_ground(tags: Column) -> Column:
    """Whether any tag places the feature above or below ground."""
    return either(*[F.coalesce(~tag(tags, k).isin("no", "0"), F.lit(False)) for k in OFF_GROUND])


def is_structure(tags: Column) -> Column:
    level = F.coalesce(tag(tags, "layer"), F.lit("0")) != "0"
    return either(*[F.coalesce(~tag(tags, k).isin("no", "0"), F.lit(False)) for k in ("bridge", "tunnel")], level)


def _area(tags: Column) -> Column:
    parking = (F.coalesce(tag(tags, "amenity"), F.lit("")) == "parking") & ~is_in(tag(tags, "parking"), PARKING_LEVELS)
    natural = is_in(tag(tags, "natural"), (*BARE_NATURAL, *GREEN_NATURAL))
    return ~off_ground(tags) & either(tag(tags, "surface").isNotNull(), natural, is_in(tag(tags, "leisure"), GREEN_LEISURE), is_in(tag(tags, "amenity"), SITE_AMENITY), parking)


def category(tags: Column, city: bool = False) -> Column:
    """road, building, zone, region, barrier, waterway or null; ``ambiguous`` if two of the first three hold."""
    road = F.coalesce(tag(tags, "highway") != "", F.lit(False))
    building = F.coalesce(tag(tags, "building") != "no", F.lit(False)) | tag(tags, "building:part").isNotNull()
    zone = is_in(tag(tags, "landuse"), ("forest", "orchard")) | F.coalesce(tag(tags, "natural") == "wood", F.lit(False))
    count = sum((c.cast("int") for c in (building, zone)), road.cast("int"))
    region = either(
        F.coalesce(tag(tags, "landuse") != "", F.lit(False)), is_in(tag(tags, "leisure"), ("park", "nature_reserve")),
        is_in(tag(tags, "natural"), ("water", "wetland", "bare_rock", "scrub", "grassland")), F.coalesce(tag(tags, "boundary") == "protected_area", F.lit(False)),
    )
    rules = [(count > 1, "ambiguous"), (road, "road"), (building, "building"), (zone, "zone"), (region, "region")]
    if city:
        rules += [(_area(tags), "region"), (is_in(tag(tags, "barrier"), BARRIERS), "barrier"), (is_in(tag(tags, "waterway"), WATERWAY_METRES), "waterway")]
    return first_of(*rules)


def site_kind(tags: Column) -> Column:
    return first_of((is_in(tag(tags, "amenity"), SITE_AMENITY), tag(tags, "amenity")), (is_in(tag(tags, "landuse"), SITE_LANDUSE), tag(tags, "landuse")))


def ground(tags: Column) -> tuple[Column, Column]:
    """(kind, surface) of a ground area: parking, explicit surface, green, then bare natural cover."""
    parking = (F.coalesce(tag(tags, "amenity"), F.lit("")) == "parking") & ~is_in(tag(tags, "parking"), PARKING_LEVELS)
    green = either(is_in(tag(tags, "leisure"), GREEN_LEISURE), is_in(tag(tags, "landuse"), GREEN_LANDUSE), is_in(tag(tags, "natural"), GREEN_NATURAL))
    kind = first_of((off_ground(tags), None), (parking, "parking"), (tag(tags, "surface") != "", "explicit"), (green, "green"), (is_in(tag(tags, "natural"), BARE_NATURAL), "natural"))
    return kind, F.when(kind == "natural", lookup(tag(tags, "natural"), BARE_NATURAL)).when(kind.isNotNull(), tag(tags, "surface"))


def metres(value: Column) -> Column:
    """A positive decimal number of metres up to 1000, else null."""
    number = F.when(value.rlike(r"^[0-9]+(\.[0-9]+)?( m)?$"), F.regexp_replace(value, " m$", "").cast("double"))
    return F.when((number > 0) & (number <= 1000), number)


def speed_kmh(value: Column) -> Column:
    """A posted limit of 10 to 999 km/h, else null; the Korean urban default is 50."""
    text = F.trim(value)
    return F.when(text == "KR:urban", 50).when(text.rlike("^[1-9][0-9]{1,2}( ?km/h)?$"), F.regexp_extract(text, "^([0-9]+)", 1).cast("int"))


def barrier(tags: Column) -> tuple[Column, Column, Column]:
    """(kind, height, thickness) of a barrier in metres."""
    value = tag(tags, "barrier")
    kind = F.coalesce(lookup(value, {"hedge": "hedge", "wall": "wall", "retaining_wall": "wall"}), F.lit("fence"))
    tagged = F.when(value == "fence", metres(tag(tags, "height")))
    height = F.coalesce(tagged, lookup(value, {"hedge": 0.8, "wall": 2.0, "retaining_wall": 2.0, "guard_rail": 0.8}), F.lit(1.2))
    return kind, height, lookup(kind, {"hedge": 0.6, "fence": 0.1, "wall": 0.3})


def gate_width(tags: Column) -> Column:
    """Opening of a gate node in metres: its width tag, 3 for vehicles, 1.5 on foot; null where it is no gate."""
    value = tag(tags, "barrier")
    base = F.when(is_in(value, VEHICLE_GATES), 3.0).when(is_in(value, PEDESTRIAN_GATES), 1.5)
    return F.when(base.isNotNull(), F.coalesce(metres(tag(tags, "width")), base))


def surface(value: Column) -> Column:
    """One of five physical surfaces; an unknown one counts as asphalt."""
    return F.coalesce(lookup(value, SURFACES), F.lit("asphalt"))


def oneway(tags: Column) -> Column:
    """1 along the geometry, -1 against it, 0 both ways."""
    value = tag(tags, "oneway")
    return F.coalesce(
        first_of(
            (value.isin("yes", "true", "1"), 1), (value.isin("-1", "reverse"), -1), (value.isin("no", "false", "0"), 0),
            (tag(tags, "highway") == "motorway", 1), (tag(tags, "junction").isin("roundabout", "circular"), 1),
        ).cast("int"),
        F.lit(0),
    )


def _count(value: Column) -> Column:
    return F.when(value.rlike("^[1-9][0-9]*$"), value.cast("int"))


def lanes(tags: Column) -> Column:
    """Lanes in total: the tag, both directions added up, or the one direction of a one-way road; above 16 gives null."""
    total, forward, backward, middle = (_count(tag(tags, k)) for k in ("lanes", "lanes:forward", "lanes:backward", "lanes:both_ways"))
    one = F.when(oneway(tags) != 0, F.coalesce(forward, backward))
    found = F.coalesce(total, forward + backward + F.coalesce(middle, F.lit(0)), one)
    return F.when(found <= MOST_LANES, found)


def width(tags: Column, class_metres: dict[str, float], default: float = 8.0) -> tuple[Column, Column]:
    """(metres, basis): the width tag, else the lanes, else the road class."""
    by_lanes = F.round(lanes(tags) * LANE_METRES + LANE_MARGIN, 2)
    tagged = metres(tag(tags, "width"))
    value = F.coalesce(tagged, by_lanes, lookup(tag(tags, "highway"), class_metres), F.lit(default))
    return value, F.when(tagged.isNotNull(), "tag").when(by_lanes.isNotNull(), "lanes").otherwise("class")


def sidewalk_state(tags: Column) -> Column:
    """no, separate, yes or null."""
    both = [tag(tags, k) for k in ("sidewalk", "sidewalk:both")]
    left, right = tag(tags, "sidewalk:left"), tag(tags, "sidewalk:right")
    no = either(*[is_in(v, ("no", "none")) for v in both], F.coalesce((left == "no") & (right == "no"), F.lit(False)))
    separate = either(*[is_in(v, ("separate",)) for v in (*both, left, right)])
    yes = either(*[is_in(v, ("both", "left", "right", "yes")) for v in both], *[is_in(v, ("yes",)) for v in (left, right)])
    return first_of((no, "no"), (separate, "separate"), (yes, "yes"))


def sidewalk_cm(value: Column, scale: int = 3) -> Column:
    """Metres as whole map centimetres: 0, or 20 to 1000."""
    cm = F.bround(value * 100 / scale).cast("int")
    return F.least(F.when(cm >= 20, cm).when(cm >= 10, 20).otherwise(0), F.lit(1000))


def zone(tags: Column, area_m2: Column) -> tuple[Column, Column, Column]:
    """(kind, spacing, density per mille) of a vegetation area; grass counts as lawn from 300 square metres."""
    use = F.coalesce(tag(tags, "landuse"), F.when(tag(tags, "natural") == "wood", "forest"), tag(tags, "natural"), tag(tags, "leisure"))
    kind = first_of((use.isin("scrub", "heath"), "scrub"), (use.isin("forest", "orchard"), "forest"), (use.isin("park", "garden", "recreation_ground", "village_green"), "park"), ((use == "grass") & (area_m2 >= 300), "lawn"))
    return kind, lookup(kind, {k: v[0] for k, v in ZONES.items()}), lookup(kind, {k: v[1] for k, v in ZONES.items()})


def tree_hint(tags: Column) -> Column:
    """Species group by the words of a tree's names, in order; needle leaves count as pine."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(tag(tags, k), F.lit("")) for k in ("genus", "species", "species:ko", "species:en", "taxon", "name", "name:ko")]))
    rules = [(either(*[text.contains(w) for w in ws]), hint) for hint, ws in TREE_WORDS]
    return F.coalesce(first_of(*rules, (tag(tags, "leaf_type") == "needleleaved", "pine")), F.lit("tree"))


#: Settlements with houses of one storey and a roof. Fixed values.
RURAL = ("rural", "village", "sparse", "wilderness")


def profile_height(kind: Column, settlement: Column) -> Column:
    """Metres of an untagged building by its type and settlement."""
    floors = F.when(kind.isin("apartment", "residential_tower", "office", "hotel", "hospital"), 4).when(kind.isin("utility", "research"), 1).otherwise(2)
    return F.when(kind.isin("detached", "farmhouse") & settlement.isin(*RURAL), 5).otherwise(3 * floors)


def style_id(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)
