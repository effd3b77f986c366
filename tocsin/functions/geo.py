"""Geometry on a sphere of 6371 km as Column expressions; angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: Kilometres in a degree, in the flat projection around a point.
DEGREE_KM = 111.32


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return RADIUS_KM * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing, from 0 up to 360."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    d, a, b = F.radians(lng2 - lng1), F.radians(lat1), F.radians(lat2)
    return (F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + F.lit(360.0)) % F.lit(360.0)


def destination(lat, lng, direction, km) -> Column:
    """struct(lat, lng) of the point ``km`` away."""
    lat, lng, direction, km = map(_c, (lat, lng, direction, km))
    s, a = km / RADIUS_KM, F.radians(lat)
    end = F.asin(F.sin(a) * F.cos(s) + F.cos(a) * F.sin(s) * F.cos(F.radians(direction)))
    turn = F.atan2(F.sin(F.radians(direction)) * F.sin(s) * F.cos(a), F.cos(s) - F.sin(a) * F.sin(end))
    return F.struct(F.degrees(end).alias("lat"), ((F.degrees(F.radians(lng) + turn) + F.lit(540.0)) % F.lit(360.0) - F.lit(180.0)).alias("lng"))


def project(lat, lng, direction, speed_kmh, seconds) -> Column:
    """Dead reckoning: where a target is after some seconds; without a bearing, speed or time, where it was."""
    lat, lng = _c(lat), _c(lng)
    moved = destination(lat, lng, direction, _c(speed_kmh) * _c(seconds) / 3600)
    return F.when(_c(direction).isNull() | (_c(speed_kmh) <= 0) | (_c(seconds) <= 0), F.struct(lat.alias("lat"), lng.alias("lng"))).otherwise(moved)


def ingress_origin(lat, lng, weapon: Column, center: tuple[float, float], distances: dict[str, float]) -> Column:
    """Where a target that heads for a place is taken to come from: beyond it, seen from the centre."""
    km = F.create_map(*(F.lit(x) for k, v in distances.items() for x in (k, float(v))))[weapon]
    away = (bearing(lat, lng, *center) + 180.0) % F.lit(360.0)
    return F.when(km.isNotNull(), destination(lat, lng, away, km))


def edges(ring: Column) -> Column:
    """Pairs (a, b) of successive corners of a ring of struct(lng, lat), closed."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(lng, lat, ring: Column) -> Column:
    """Ray casting: an odd number of edges lie to the east."""
    lng, lat = _c(lng), _c(lat)

    def crossed(e: Column) -> Column:
        (ax, ay), (bx, by) = (e["a"]["lng"], e["a"]["lat"]), (e["b"]["lng"], e["b"]["lat"])
        return ((by > lat) != (ay > lat)) & (lng < (ax - bx) * (lat - by) / (ay - by + F.lit(1e-20)) + bx)

    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def ring_distance_km(lat, lng, ring: Column) -> Column:
    """Shortest distance to the ring's edges, on a flat projection around the point."""
    lat, lng = _c(lat), _c(lng)
    scale = F.cos(F.radians(lat)) * DEGREE_KM

    def away(e: Column) -> Column:
        ax, ay = (e["a"]["lng"] - lng) * scale, (e["a"]["lat"] - lat) * DEGREE_KM
        ux, uy = (e["b"]["lng"] - lng) * scale - ax, (e["b"]["lat"] - lat) * DEGREE_KM - ay
        size = ux * ux + uy * uy
        t = F.when(size < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * ux + ay * uy) / size)))
        return F.hypot(ax + t * ux, ay + t * uy)

    return F.array_min(F.transform(edges(ring), away))


def segment_enters(lat1, lng1, lat2, lng2, ring: Column, steps: int = 8) -> Column:
    """Whether one of the inner points that cut the segment into ``steps`` lies in the ring."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    hit = F.lit(False)
    for k in range(1, steps):
        t = k / steps
        hit = hit | in_ring(lng1 + t * (lng2 - lng1), lat1 + t * (lat2 - lat1), ring)
    return hit


def centroid(ring: Column) -> Column:
    """Mean of the corners; of a ring that repeats its first corner, without the repetition."""
    open_ring = F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    mean = lambda f: F.aggregate(open_ring, F.lit(0.0), lambda s, p: s + p[f]) / F.size(open_ring)
    return F.struct(mean("lat").alias("lat"), mean("lng").alias("lng"))


def box(ring: Column) -> Column:
    """struct(lat0, lat1, lng0, lng1) around a ring."""
    of = lambda f, g: f(F.transform(ring, lambda p: p[g]))
    return F.struct(of(F.array_min, "lat").alias("lat0"), of(F.array_max, "lat").alias("lat1"), of(F.array_min, "lng").alias("lng0"), of(F.array_max, "lng").alias("lng1"))


def midpoint(lat1, lng1, lat2, lng2) -> Column:
    return F.struct(((_c(lat1) + _c(lat2)) / 2).alias("lat"), ((_c(lng1) + _c(lng2)) / 2).alias("lng"))


def interpolate(a, b, t) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def arrow_length(speed_kmh: Column) -> Column:
    """How long a map draws a speed: 28 to 72, growing up to 2200 km/h."""
    share = F.least(F.lit(1.0), F.greatest(speed_kmh, F.lit(0.0)) / 2200)
    return F.floor(28 + share * 44 + 0.5).cast("int")
