"""Integer and geographic geometry as column expressions.

Coordinates are whole centimetres (BIGINT) unless said otherwise; cross products stay below 2**63
while coordinates stay within 10**8. A null coordinate gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Sign of the turn a -> b -> c: 1 left, -1 right, 0 straight."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("int")


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a point lies on a closed segment."""
    inside = px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
    return (orientation(ax, ay, bx, by, px, py) == 0) & inside


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments cross properly: each one's ends lie strictly on both sides of the other."""
    return (orientation(ax, ay, bx, by, cx, cy) * orientation(ax, ay, bx, by, dx, dy) < 0) & (orientation(cx, cy, dx, dy, ax, ay) * orientation(cx, cy, dx, dy, bx, by) < 0)


def point_segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment, in double precision."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def segment_gap2(*c: Column) -> Column:
    """Squared distance of two segments (ax, ay, bx, by, cx, cy, dx, dy); 0 where they cross or touch."""
    a, b, p, q = (c[i : i + 2] for i in (0, 2, 4, 6))
    ends = [point_segment_distance2(*x, *y) for x, y in ((a, (*p, *q)), (b, (*p, *q)), (p, (*a, *b)), (q, (*a, *b)))]
    return F.when(segments_cross(*c), 0.0).otherwise(F.least(*ends))


def ring_area2(xs: Column, ys: Column) -> Column:
    """Twice the signed area of a closed ring given as coordinate arrays without the closing vertex."""
    n = F.size(xs)
    nxt = lambda a, i: F.element_at(a, F.when(i + 1 < n, i + 2).otherwise(F.lit(1)).cast("int"))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(xs, (i + 1).cast("int")) * nxt(ys, i) - nxt(xs, i) * F.element_at(ys, (i + 1).cast("int")))
    return F.when(n > 0, F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def snap(value: Column, step: int) -> Column:
    """Nearest multiple of ``step``, halves away from zero."""
    return (F.signum(value.cast("double")) * F.floor(F.abs(value) / F.lit(float(step)) + 0.5) * step).cast("bigint")


def scaled(value: Column, divisor: int) -> Column:
    """A length at scale 1:divisor in whole units, halves away from zero."""
    return F.round(value / F.lit(float(divisor))).cast("bigint")


def clip_interval(ax, ay, bx, by, west, south, east, north) -> tuple[Column, Column]:
    """Parameters (t0, t1) of a segment's part within a rectangle; null where it stays outside."""
    def slab(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
        d = (b - a).cast("double")
        u, v = (low - a) / d, (high - a) / d
        flat = d == 0
        return F.when(flat, F.lit(0.0)).otherwise(F.least(u, v)), F.when(flat, F.lit(1.0)).otherwise(F.greatest(u, v)), flat & ~a.between(low, high)

    x0, x1, miss_x = slab(ax, bx, west, east)
    y0, y1, miss_y = slab(ay, by, south, north)
    t0, t1 = F.greatest(F.lit(0.0), x0, y0), F.least(F.lit(1.0), x1, y1)
    hit = ~miss_x & ~miss_y & (t0 <= t1)
    return F.when(hit, t0), F.when(hit, t1)


def equirectangular(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, at the origin's latitude."""
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def source_area_m2(area2_degrees: Column, lat: Column) -> Column:
    """Square metres of a footprint from twice its area in square degrees, at its latitude."""
    return F.abs(area2_degrees) / 2.0 * METRES_PER_DEGREE**2 * F.cos(F.radians(lat))


def utm(lon: Column, lat: Column, origin_lon: float, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres (WGS 84, UTM zone of the origin), by Krueger's series of third order."""
    a, f = 6_378_137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    centre = math.floor((origin_lon + 180) / 6) * 6 - 177
    phi, lam = F.radians(lat), F.radians(lon - F.lit(float(centre)))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = 0.9996 * radius
    return 500_000 + k * east, (10_000_000 if south else 0) + k * north


def morton(x: Column, y: Column, bits: int = 21) -> Column:
    """Z-order key of two cell numbers within +-2**(bits - 1)."""
    x, y = x + F.lit(1 << (bits - 1)), y + F.lit(1 << (bits - 1))
    code = F.lit(0).cast("bigint")
    for b in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("bigint")), 2 * b))
        code = code.bitwiseOR(F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1).cast("bigint")), 2 * b + 1))
    return code


def seeded(n: int, *parts: Column) -> Column:
    """A stable integer in 0 .. n - 1 from text parts: the first 64 bits of their SHA-256, modulo n."""
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("bigint")


def canonical_ring(vertices: Column) -> Column:
    """A ring's ids rotated to begin with the smallest, in the direction that sorts first."""
    def turned(a: Column) -> Column:
        at = F.array_position(a, F.array_min(a)).cast("int")
        return F.concat(F.slice(a, at, F.size(a)), F.slice(a, F.lit(1), at - 1))

    return F.when(F.size(vertices) == 0, vertices).otherwise(F.least(turned(vertices), turned(F.reverse(vertices))))


def is_axis_rectangle(xs: Column, ys: Column) -> Column:
    """Whether four vertices form an axis-aligned rectangle."""
    return (F.size(xs) == 4) & (F.size(F.array_distinct(xs)) == 2) & (F.size(F.array_distinct(ys)) == 2) & (F.abs(ring_area2(xs, ys)) == 2 * (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys)))


def tile_name(lon: Column, lat: Column) -> Column:
    """Name of the one-degree elevation tile that holds a point, by its south-west corner."""
    part = lambda v, plus, minus, width: F.concat(F.when(v < 0, minus).otherwise(plus), F.lpad(F.abs(F.floor(v)).cast("string"), width, "0"))
    return F.concat(part(lat, "N", "S", 2), F.lit("_"), part(lon, "E", "W", 3))


def quarter_turns(angle_degrees: Column) -> Column:
    """Whole quarter turns nearest to an angle, 0 to 3."""
    return F.pmod(F.round(angle_degrees / 90.0).cast("int"), F.lit(4))
