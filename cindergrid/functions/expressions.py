"""Column expressions: time bins, wind, distances, projection and missing values."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: WGS84 ellipsoid and the transverse Mercator scale and false origin of UTM.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_NORTH_SOUTH = 0.9996, 500000.0, 10000000.0


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null."""
    return df.select(*(F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def coerce_numeric(c: Column) -> Column:
    return c.try_cast("double")


def floor_time_bin(ts: Column, minutes: int) -> Column:
    """Start of the bin of so many minutes that holds the timestamp."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(minutes * 60_000_000)))


def epoch_hours(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("long")


#: Accepted spellings of a date and time.
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HHmm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def to_time(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATETIME_FORMATS))


def parse_datetime(df: DataFrame, into: str = "datetime") -> DataFrame:
    """A timestamp from, in this order: datetime; date and time; acq_date and acq_time; the first of acq_date, timestamp, date, time.

    Whole-number times of day are padded to HHmm. Text that fits no format, and a bare time of day, give null.
    """
    kind = dict(df.dtypes)
    time = lambda c: F.when(F.col(c).cast("string").rlike(r"^\d{1,4}$"), F.lpad(F.col(c).cast("string"), 4, "0")).otherwise(F.col(c).cast("string"))
    for day, hour in (("datetime", None), ("date", "time"), ("acq_date", "acq_time"), ("acq_date", None), ("timestamp", None), ("date", None), ("time", None)):
        if day in kind and (hour is None or hour in kind):
            if hour:
                return df.withColumn(into, to_time(F.concat(F.col(day).cast("string"), F.lit(" "), time(hour))))
            return df.withColumn(into, F.col(day).cast("timestamp") if kind[day].startswith("timestamp") else to_time(F.col(day).cast("string")))
    raise ValueError("no date or time column")


def angle_deg(dy: Column, dx: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(360.0))


def wind_features(df: DataFrame, u: str = "u10", v: str = "v10") -> DataFrame:
    """wind_speed and wind_dir_deg, if both components exist."""
    if u not in df.columns or v not in df.columns:
        return df
    u_, v_ = coerce_numeric(F.col(u)), coerce_numeric(F.col(v))
    return df.withColumns({u: u_, v: v_}).withColumns({"wind_speed": F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v)), "wind_dir_deg": angle_deg(F.col(v), F.col(u))})


def wind_align(direction: Column | None, angle: Column) -> Column:
    """Cosine between wind and edge; 0 without wind."""
    if direction is None:
        return F.lit(0.0)
    return F.coalesce(F.cos(F.radians(direction - angle)), F.lit(0.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance_kernel(d: Column, scale: Column) -> Column:
    return F.when(scale > 0, F.exp(-d / scale)).otherwise(1 / (1 + d))


def wind_reweight(weight: Column, direction: Column, angle: Column, strength: float) -> Column:
    """Stronger along the wind; unchanged where direction or angle is null."""
    return F.coalesce(weight * (1 + strength * F.greatest(F.lit(0.0), F.cos(F.radians(direction - angle)))), weight)


def utm_zone(lon: float, lat: float) -> tuple[int, bool]:
    """Zone number and whether north, of the centre of the data."""
    return min(60, int((lon + 180) // 6) + 1), lat >= 0


#: Numerators and denominators of the Krueger series' terms by power of the third flattening, from the first that isn't 0.
FORWARD = (
    ("1/2", "-2/3", "5/16", "41/180", "-127/288", "7891/37800"),
    ("13/48", "-3/5", "557/1440", "281/630", "-1983433/1935360"),
    ("61/240", "-103/140", "15061/26880", "167603/181440"),
    ("49561/161280", "-179/168", "6601661/7257600"),
    ("34729/80640", "-3418889/1995840"),
    ("212378941/319334400",),
)
BACKWARD = (
    ("1/2", "-2/3", "37/96", "-1/360", "-81/512", "96199/604800"),
    ("1/48", "1/15", "-437/1440", "46/105", "-1118711/3870720"),
    ("17/480", "-37/840", "-209/4480", "5569/90720"),
    ("4397/161280", "-11/504", "-830251/7257600"),
    ("4583/161280", "-108847/3991680"),
    ("20648693/638668800",),
)
GEODETIC = (
    ("2", "-2/3", "-2", "116/45", "26/45", "-2854/675"),
    ("7/3", "-8/5", "-227/45", "2704/315", "2323/945"),
    ("56/15", "-136/35", "-1262/105", "73814/2835"),
    ("4279/630", "-332/35", "-399572/14175"),
    ("4174/315", "-144838/6237"),
    ("601676/22275",),
)


def _sums(terms: tuple) -> list[float]:
    n = WGS84_F / (2 - WGS84_F)
    return [sum(float(Fraction(c)) * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(terms, 1)]


def _radius() -> float:
    n = WGS84_F / (2 - WGS84_F)
    return WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def project_utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Metres east and north by the Krueger series (sixth order in the third flattening)."""
    radius, alpha = _radius(), _sums(FORWARD)
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * radius * x, (0.0 if north else UTM_NORTH_SOUTH) + UTM_SCALE * radius * y


def unproject_utm(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of metres east and north."""
    radius, beta = _radius(), _sums(BACKWARD)
    xi0 = (y - (0.0 if north else UTM_NORTH_SOUTH)) / (UTM_SCALE * radius)
    eta0 = (x - UTM_EAST) / (UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    # conformal to geodetic latitude
    phi = chi
    for j, k in enumerate(_sums(GEODETIC), 1):
        phi = phi + k * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(phi)
