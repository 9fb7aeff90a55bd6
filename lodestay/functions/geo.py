"""Geographic expressions, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Walking distance is the straight line times this, at so many metres a minute.
DETOUR, METRES_A_MINUTE = 1.25, 80.0
WALK_LIMIT = 20.0
METRES_A_DEGREE, MERCATOR_M = 111_320.0, 6_378_137.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def walk_minutes(metres: Column) -> Column:
    return metres * DETOUR / METRES_A_MINUTE


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over a ring array<struct<lat, lon>>; the last point joins the first; null coordinates give null."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        # nullif keeps level edges, which span nothing, from dividing by zero
        at = a["lon"] + (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.coalesce(spans & (lon < at), F.lit(False))

    inside = F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))
    return F.when(lat.isNotNull() & lon.isNotNull(), inside)


def tier(inside: Column, minutes: Column, limit: float = WALK_LIMIT) -> Column:
    """GREEN inside the zone, AMBER within the walk, RED beyond; UNKNOWN without a point, for which ``inside`` is null.

    Where no walking time is known, ``minutes`` should be the estimate from the straight line; null is RED.
    """
    return F.when(inside.isNull(), "UNKNOWN").when(inside, "GREEN").when(minutes <= limit, "AMBER").otherwise("RED")


def nearest_gate(lat: Column, lon: Column, gates: list[tuple[str, float, float]]) -> Column:
    """struct<metres, gate> of the nearest of a few gates, of equal ones the first by name; null without a point."""
    far = [F.struct(haversine(lat, lon, F.lit(a), F.lit(b)).alias("metres"), F.lit(name).alias("gate")) for name, a, b in gates]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(F.array(*far)))


def walk_or_estimate(minutes: Column, lat: Column, lon: Column, gates: list[tuple[str, float, float]]) -> Column:
    """The known walking time, else the estimate from the straight line to the nearest gate."""
    return F.coalesce(minutes, walk_minutes(nearest_gate(lat, lon, gates)["metres"]))


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane of 111,320 m a degree, longitudes scaled at the first point."""
    return F.hypot((lat2 - lat1) * METRES_A_DEGREE, (lon2 - lon1) * METRES_A_DEGREE * F.cos(F.radians(lat1)))


def local_xy(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """Metres east and north in the equirectangular projection around a latitude."""
    return F.radians(lon) * EARTH_M * F.cos(F.radians(F.lit(lat0))), F.radians(lat) * EARTH_M


def edge_metres(lat: Column, lon: Column, ring: Column, lat0: float) -> Column:
    """Metres from a point to the nearest edge of a ring array<struct<lat, lon>>; null without a point."""
    x, y = local_xy(lat, lon, lat0)

    def to_edge(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i + 1 == F.size(ring), 1).otherwise(i + 2))
        (ax, ay), (bx, by) = local_xy(p["lat"], p["lon"], lat0), local_xy(q["lat"], q["lon"], lat0)
        dx, dy = bx - ax, by - ay
        along = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(x - (ax + along * dx), y - (ay + along * dy))

    return F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(F.transform(ring, to_edge)))


def in_any_ring(lat: Column, lon: Column, rings: list[tuple[str, Column]]) -> Column:
    """The name of the first ring of a few that holds a point, or null."""
    return F.coalesce(*(F.when(in_ring(lat, lon, ring), name) for name, ring in rings), F.lit(None).cast("string"))


def effective_tier(base: Column, in_no_amber: Column, in_allowed: Column) -> Column:
    """A tier with two masks: no AMBER in some areas, nothing outside the allowed ones; an unknown mask hides nothing."""
    masked = ((base == "AMBER") & F.coalesce(in_no_amber, F.lit(False))) | ~F.coalesce(in_allowed, F.lit(True))
    return F.when(base.isin("GREEN", "AMBER") & masked, "RED").otherwise(base)


def landmark_grade(extent_m: Column) -> Column:
    """How exact a landmark's centre is: by its extent a point, a street or an area."""
    return F.when(extent_m <= 150, "static").when(extent_m <= 400, "street_geom").when(extent_m.isNotNull(), "static_area")


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web Mercator metres east and north."""
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of Web Mercator metres."""
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - F.lit(1.5707963267948966)), F.degrees(x / MERCATOR_M)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a point lies in a box; false without one."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def ring_extent(ring: Column) -> Column:
    """The greatest distance between two of a ring's points, in metres."""
    pairs = F.flatten(F.transform(ring, lambda p: F.transform(ring, lambda q: haversine(p["lat"], p["lon"], q["lat"], q["lon"]))))
    return F.array_max(pairs)


def ring_centre(ring: Column) -> Column:
    """struct<lat, lon>: the mean of a ring's points, a repeated closing point left out."""
    closed = (F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1))
    points = F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    mean = lambda part: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[part]) / F.size(points)
    return F.when(F.size(ring) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def cell(value: Column, size: float) -> Column:
    """Grid cell number, truncated toward zero."""
    return (value / size).cast("int")
