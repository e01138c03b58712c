"""Fixed-point places: nanodegrees and nanometres are integers, doubles live only inside formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREE = 1_000_000_000
RADIUS_M = 6_371_007.1809
TOLERANCE_M = 0.002


def canonical_longitude(lon: Column, lat: Column) -> Column:
    """+180 becomes -180, a pole has longitude 0, out of range is null."""
    inside = lon.between(-180 * DEGREE, 180 * DEGREE) & lat.between(-90 * DEGREE, 90 * DEGREE)
    return F.when(~inside, None).when(F.abs(lat) == 90 * DEGREE, F.lit(0)).when(lon == 180 * DEGREE, F.lit(-180 * DEGREE)).otherwise(lon).cast("long")


def in_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed box; west > east goes over the antimeridian, equal ones are one meridian; poles have every longitude."""
    across = F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))
    return lat.between(south, north) & (across | (F.abs(lat) == 90 * DEGREE))


def in_local_box(coordinates: list[Column], low: list[Column], high: list[Column]) -> Column:
    out = F.lit(True)
    for c, a, b in zip(coordinates, low, high):
        out = out & c.between(a, b)
    return out


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the authalic sphere."""
    rad = lambda c: F.radians(c / DEGREE)
    a, b = F.sin((rad(lat2) - rad(lat1)) / 2), F.sin((rad(lon2) - rad(lon1)) / 2)
    h = a * a + F.cos(rad(lat1)) * F.cos(rad(lat2)) * b * b
    return 2 * RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def distance_mm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Millimetres, ties to even."""
    return F.bround(great_circle_m(lon1, lat1, lon2, lat2) * 1000).cast("long")


def to_parent(x: Column, y: Column, quarter_turns: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """A point of a child frame in its parent: rotation by quarter turns, then translation; exact in integers."""
    q = F.pmod(quarter_turns, F.lit(4))
    rx = F.when(q == 0, x).when(q == 1, -y).when(q == 2, -x).otherwise(y)
    ry = F.when(q == 0, y).when(q == 1, x).when(q == 2, -y).otherwise(-x)
    return rx + dx, ry + dy


def geodetic_to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """WGS84 longitude, latitude (nanodegrees) and height (metres) to earth-centred metres."""
    a, e2 = 6_378_137.0, 6.69437999014e-3
    la, lo = F.radians(lat / DEGREE), F.radians(lon / DEGREE)
    n = a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + height) * F.cos(la) * F.cos(lo), (n + height) * F.cos(la) * F.sin(lo), (n * (1 - e2) + height) * F.sin(la)


def ecef_to_enu(x: Column, y: Column, z: Column, lon0: Column, lat0: Column, height0: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres to east, north and up of an origin."""
    x0, y0, z0 = geodetic_to_ecef(lon0, lat0, height0)
    la, lo = F.radians(lat0 / DEGREE), F.radians(lon0 / DEGREE)
    dx, dy, dz = x - x0, y - y0, z - z0
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    return east, north, F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The inverse, by ten rounds of latitude iteration."""
    a, e2 = 6_378_137.0, 6.69437999014e-3
    p = F.sqrt(x * x + y * y)
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(10)),
        F.atan2(z, p * (1 - e2)),
        lambda la, _: F.atan2(z + e2 * a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la)) * F.sin(la), p),
    )
    return F.degrees(F.atan2(y, x)), F.degrees(state), p * F.cos(state) + z * F.sin(state) - a * F.sqrt(1 - e2 * F.sin(state) * F.sin(state))


def frame_accepts(frame_kind: Column, position_kind: Column) -> Column:
    """A position fits a frame of the same coordinate system."""
    return F.coalesce(frame_kind == position_kind, F.lit(False))
