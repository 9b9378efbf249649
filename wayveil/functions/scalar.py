"""Column functions on coordinates and times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
EARTH_M = 6_371_000.0
DEGREE_M = 111_000.0
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EAST = 500_000.0


def within_bounds(x: Column, y: Column, left: float, right: float, bottom: float, top: float) -> Column:
    """Inside the closed box."""
    return x.between(left, right) & y.between(bottom, top)


def within_dates(ts: Column, low: datetime | str, high: datetime | str) -> Column:
    """Inside the closed window."""
    return ts.between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp"))


def off_null_island(lon: Column, lat: Column) -> Column:
    """True unless a coordinate is exactly 0."""
    return (lon != 0) & (lat != 0)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great circle distance in metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar_dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def planar_speed(x1: Column, y1: Column, x2: Column, y2: Column, seconds: Column) -> Column:
    """Metres a second of a move in degrees; null where no time passes."""
    return planar_dist(x1, y1, x2, y2) * DEGREE_M / F.nullif(seconds, F.lit(0))


def local_origin(pts: DataFrame, lon: str = "x", lat: str = "y") -> tuple[float, float]:
    """Mean coordinates: one row comes to the driver."""
    row = pts.agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat")).first()
    return row["lon"], row["lat"]


def to_local_xy(lon: Column, lat: Column, origin: tuple[float, float]) -> tuple[Column, Column]:
    """Equirectangular metres around the origin."""
    east = F.radians(lon - F.lit(origin[0])) * F.cos(F.radians(F.lit(origin[1]))) * EARTH_M
    return east, F.radians(lat - F.lit(origin[1])) * EARTH_M


def _kruger() -> tuple[float, float, tuple, tuple]:
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ahead = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return n, radius, ahead, back


def gps_to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on the northern hemisphere, by Krueger's series (well under a millimetre inside the zone)."""
    n, radius, ahead, _ = _kruger()
    e = 2 * n**0.5 / (1 + n)
    p, away = F.radians(lat), F.radians(lon - F.lit(zone * 6 - 183.0))
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ahead, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def utm_to_gps(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of gps_to_utm's result."""
    n, radius, _, back = _kruger()
    e = 2 * n**0.5 / (1 + n)
    xi0, eta0 = north / (UTM_SCALE * radius), (east - UTM_EAST) / (UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(back, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    target = F.asinh(F.sin(xi) / F.sqrt(F.pow(F.sinh(eta), 2) + F.pow(F.cos(xi), 2)))
    p = F.asin(F.tanh(target))
    for _ in range(5):  # isometric latitude back to latitude; each step gains two digits or more
        p = F.asin(F.tanh(target + e * F.atanh(e * F.sin(p))))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183.0), F.degrees(p)


def scale_coord(v: Column, low: float, rate: float) -> Column:
    return (v - low) * rate


def unscale_coord(v: Column, bias: float, rate: float) -> Column:
    return v / rate + bias


def fix_date(ts: Column, date: str) -> Column:
    """The same time of day on another date."""
    return F.to_timestamp(F.concat(F.lit(f"{date} "), F.date_format(ts, "HH:mm:ss")))


def time_index(ts: Column, start: str, step_min: float) -> Column:
    """Bin of the time of day, from `start` (HH:mm:ss) on; an exact edge belongs to the bin before; 0 at least."""
    h, m, s = map(int, start.split(":"))
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    passed = F.pmod(of_day - (h * 3600 + m * 60 + s), F.lit(86_400))
    step = step_min * 60
    k = F.floor(passed / step)
    return F.greatest(F.when(passed == k * step, k - 1).otherwise(k), F.lit(0)).cast("int")


def point_time(start_epoch: Column, k: Column, step_s: int = 15) -> Column:
    """Time of the k-th point of a line sampled at a fixed rate."""
    return F.timestamp_seconds(start_epoch + k * step_s)


def dist_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment; from its first end where the segment has no length."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def coord_key(lon: Column, lat: Column, digits: int = 7) -> Column:
    """Integers of rounded coordinates, as one key."""
    return F.struct(F.round(lon * 10**digits).cast("long").alias("kx"), F.round(lat * 10**digits).cast("long").alias("ky"))


def parse_ts(text: Column) -> Column:
    """The first of three formats that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])


def swap_lonlat(pts: DataFrame) -> DataFrame:
    return pts.withColumns({"x": F.col("y"), "y": F.col("x")})


def strip_time(pts: DataFrame) -> DataFrame:
    return pts.drop("ts")


def unit_hash(*key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the key and seed alone, so partitioning does not change it."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
