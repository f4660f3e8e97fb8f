"""Column expressions: predicates, keys and kernels that stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.spec import check_region


def inside(e: Column, n: Column, region) -> Column:
    """Within the region, borders included."""
    w, east, s, north = check_region(region)
    return e.between(w, east) & n.between(s, north)


def cell_index(x: Column, start: float, stop: float, size: int) -> Column:
    """Which of ``size`` equal cells between start and stop; points beyond go to the border cells."""
    if stop <= start:
        return F.lit(0).cast("long")
    raw = F.floor((x - F.lit(float(start))) / F.lit((stop - start) / size))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(size - 1)).cast("long")


def longitude_region(region):
    """(region in its chosen convention, whether that is 0..360): the driver's half of longitude continuity.

    The convention is 0..360, unless the region would be torn apart there because it holds the
    zero meridian; a full circle is 0..360 whatever its ends.
    """
    w, e, s, n = map(float, region)
    rules = {
        "Longitudes lie in -180..360": -180 <= min(w, e) and max(w, e) <= 360,
        "Latitudes lie in -90..90": -90 <= min(s, n) and max(s, n) <= 90,
        "South is not beyond north": s <= n,
        "East and west are 360 degrees apart at most": abs(e - w) <= 360,
    }
    for rule, holds in rules.items():
        if not holds:
            raise ValueError(f"{rule}, not in {region}")
    if math.isclose(abs(e - w), 360):
        return (0.0, 360.0, s, n), True
    torn = w % 360 > e % 360
    least = -180.0 if torn else 0.0
    return (*((v - least) % 360 + least for v in (w, e)), s, n), not torn


def _within(x: Column, low: float, high: float, what: str, value: Column) -> Column:
    """``value``, and an error in the row where ``x`` is outside of a range (null and nan pass)."""
    fine = x.isNull() | F.isnan(x) | x.between(low, high)
    return F.when(fine, value).otherwise(F.raise_error(F.concat(F.lit(f"{what} outside of {low:g}..{high:g}: "), x.cast("string"))).cast("double"))


def wrap_longitude(lon: Column, positive: bool) -> Column:
    """Longitudes in 0..360 or in -180..180 (end excluded); those outside of -180..360 are an error."""
    lon = lon.cast("double")
    least = F.lit(0.0 if positive else -180.0)
    return _within(lon, -180, 360, "Longitude", F.pmod(lon - least, F.lit(360.0)) + least)


def checked_latitude(lat: Column) -> Column:
    """Latitudes as they are; those outside of -90..90 are an error."""
    return _within(lat.cast("double"), -90, 90, "Latitude", lat.cast("double"))


def checkerboard(e: Column, n: Column, amplitude: float, w_east: float, w_north: float) -> Column:
    return F.lit(float(amplitude)) * F.sin(F.lit(2 * math.pi / w_east) * e) * F.cos(F.lit(2 * math.pi / w_north) * n)


def biharmonic(de: Column, dn: Column, mindist: float = 0.0) -> Column:
    """Green's function of the biharmonic spline for coordinate differences."""
    r = F.hypot(de, dn) + F.lit(float(mindist))
    return F.when(r < 1, r * (F.ln(F.pow(r, r)) - r)).otherwise(r * r * (F.ln(r) - 1))


def elastic(de: Column, dn: Column, poisson: float, mindist: float) -> tuple[Column, Column, Column]:
    """(ee, nn, ne) kernels of two-dimensional elasticity."""
    r = F.hypot(de, dn) + F.lit(float(mindist))
    shared, over = (3 - poisson) * F.ln(r), (1 + poisson) / (r * r)
    return shared + over * dn * dn, shared + over * de * de, -(over * de * dn)


def mercator(lon: Column, lat: Column, radius: float = 6371000.0) -> tuple[Column, Column]:
    """Spherical Mercator, the closed-form projection that ships with the package."""
    return F.radians(lon) * radius, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius
