"""Geodesy and plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR, SEMI_MINOR = 6378137.0, 6356752.314245
_E2 = (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2
_CURVE = SEMI_MAJOR**2 / SEMI_MINOR
SCALE = 0.9996
EARTH_KM = 6371.0
#: Latitude bands of eight degrees from -80 on.
BANDS = "CDEFGHJKLMNPQRSTUVWX"
FEET_M = {"international": 0.3048, "survey": 1200.0 / 3937.0}


def _arc(lat: Column) -> Column:
    """Length of the meridian up to a latitude in radians, scaled."""
    alpha = 0.75 * _E2
    beta, gamma = 5.0 / 3.0 * alpha**2, 35.0 / 27.0 * alpha**3
    cos2 = F.pow(F.cos(lat), F.lit(2.0))
    s2 = F.sin(lat * 2.0)
    a2 = s2 * cos2
    j2 = lat + s2 / 2.0
    j4 = (j2 * 3.0 + a2) / 4.0
    j6 = (j4 * 5.0 + a2 * cos2) / 3.0
    return (lat - j2 * alpha + j4 * beta - j6 * gamma) * (SCALE * _CURVE)


def _normal(lat: Column) -> Column:
    return F.lit(_CURVE * SCALE) / F.sqrt(F.pow(F.cos(lat), F.lit(2.0)) * _E2 + 1.0)


def zone_of(lon: Column) -> Column:
    return F.floor(lon / 6.0 + 31.0).cast("int")


def band_of(lat: Column) -> Column:
    i = F.least(F.greatest(F.floor((lat + 80.0) / 8.0), F.lit(0)), F.lit(len(BANDS) - 1)).cast("int")
    return F.when(lat.isNotNull(), F.substring(F.lit(BANDS), i + 1, F.lit(1)))


def to_utm_zone(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(x, y) in a given zone; southern y gets 9999999 added."""
    phi = F.radians(lat)
    delta = F.radians(lon) - F.radians(zone * 6.0 - 183.0)
    a = F.cos(phi) * F.sin(delta)
    eps = F.log((a + 1.0) / (F.lit(1.0) - a)) * 0.5
    nu = F.atan(F.tan(phi) / F.cos(delta)) - phi
    v = _normal(phi)
    ta = F.pow(eps, F.lit(2.0)) * F.pow(F.cos(phi), F.lit(2.0)) * (_E2 / 2.0)
    x = eps * v * (ta / 3.0 + 1.0) + 500000.0
    y = nu * v * (ta + 1.0) + _arc(phi)
    return x, F.when(y < 0, y + 9999999.0).otherwise(y)


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(x, y, zone label with band letter)."""
    zone = zone_of(lon)
    x, y = to_utm_zone(lat, lon, zone.cast("double"))
    return x, y, F.concat(F.lpad(zone.cast("string"), 2, "0"), F.lit(" "), band_of(lat))


def from_utm(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """(lat, lon) of a place in a numbered zone."""
    y = F.when(north, y).otherwise(y - 10000000.0)
    phi = y / (6366197.724 * SCALE)
    cos2 = F.pow(F.cos(phi), F.lit(2.0))
    v = _normal(phi)
    a = (x - 500000.0) / v
    b = (y - _arc(phi)) / v
    small = F.pow(a, F.lit(2.0)) * (_E2 / 2.0) * cos2
    eps = a * (F.lit(1.0) - small / 3.0)
    near = b * (F.lit(1.0) - small) + phi
    delta = F.atan((F.exp(eps) - F.exp(-eps)) / 2.0 / F.cos(near))
    tau = F.atan(F.cos(delta) * F.tan(near))
    lat = phi + (cos2 * _E2 + 1.0 - F.sin(phi) * F.cos(phi) * (tau - phi) * (1.5 * _E2)) * (tau - phi)
    return F.degrees(lat), F.degrees(delta) + zone * 6.0 - 183.0


def to_tm(lat: Column, lon: Column, lat0: Column, lon0: Column, scale: Column, false_x: Column, false_y: Column) -> tuple[Column, Column]:
    """Transverse Mercator with a projection's own parameters."""
    x, y = to_utm_zone(lat, lon - lon0 + 3.0, F.lit(31.0))
    north = F.when(lat < 0, y - 9999999.0).otherwise(y)
    return (x - 500000.0) / SCALE * scale + false_x, (north - _arc(F.radians(lat0))) / SCALE * scale + false_y


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2.0), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0), F.lit(2.0))
    return F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)) * (2.0 * EARTH_KM)


def pythag_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    x = (F.radians(lon2) - F.radians(lon1)) * F.cos((p1 + p2) / 2.0)
    y = p2 - p1
    return F.sqrt(x * x + y * y) * EARTH_KM


def dist2d(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def dist3d(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))


def dist_to_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the line through a and b; 0 where the three are in line."""
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return F.when(cross == 0, F.lit(0.0)).otherwise(F.abs(cross) / dist2d(ax, ay, bx, by))


def dms_to_deg(d: Column, m: Column, s: Column) -> Column:
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    return sign * (F.abs(d) + m / 60.0 + s / 3600.0)


def rect_from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A closed clockwise ring; null where a corner is missing."""
    lo_x, hi_x, lo_y, hi_y = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(whole, F.array(p(lo_x, lo_y), p(lo_x, hi_y), p(hi_x, hi_y), p(hi_x, lo_y), p(lo_x, lo_y)))


def rect_from_centre(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    return rect_from_corners(cx - width / 2.0, cy - height / 2.0, cx + width / 2.0, cy + height / 2.0)


def rect_from_range(values: Column) -> Column:
    """From [x_min, x_max, y_min, y_max]."""
    return rect_from_corners(values[0], values[2], values[1], values[3])


def grow_rect(ring: Column, by: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return rect_from_corners(F.array_min(xs) - by, F.array_min(ys) - by, F.array_max(xs) + by, F.array_max(ys) + by)


def assert_zone(zone: Column, expected: str) -> Column:
    return F.when(zone == expected, zone).otherwise(F.raise_error(F.concat(F.lit("unexpected zone "), F.coalesce(zone, F.lit("null")))).cast("string"))


def z_to_m(z: Column, unit: Column, foot: str = "international") -> Column:
    return F.when(unit == "ft", z * FEET_M[foot]).otherwise(z)


def clean_z(z: Column) -> Column:
    """No data becomes null, water (0) minus infinity."""
    z = F.nanvl(z, F.lit(None).cast("double"))
    return F.when((F.abs(z) > 1e38) | (z == -9999), None).when(z == 0, F.lit(float("-inf"))).otherwise(z)


def in_bbox(x: Column, y: Column, lo_x: float, hi_x: float, lo_y: float, hi_y: float) -> Column:
    """Edges included; plain comparisons, so that they reach a Parquet scan."""
    return x.between(lo_x, hi_x) & y.between(lo_y, hi_y)

