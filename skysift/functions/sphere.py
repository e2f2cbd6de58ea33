"""Sky geometry as native column expressions. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift.functions.numeric import col

# North galactic pole and galactic longitude of the celestial pole (J2000), obliquity.
POLE_RA, POLE_DEC, POLE_LON = 192.8595, 27.1284, 122.932
OBLIQUITY = 23.4393


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation (haversine)."""
    d1, d2 = F.radians(col(dec1)), F.radians(col(dec2))
    s = F.sin((d2 - d1) / 2)
    t = F.sin((F.radians(col(ra2)) - F.radians(col(ra1))) / 2)
    h = s * s + F.cos(d1) * F.cos(d2) * t * t
    return F.degrees(2.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def separation_stable(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation in the arctangent form, exact at every distance."""
    d1, d2 = F.radians(col(dec1)), F.radians(col(dec2))
    dr = F.radians(col(ra2)) - F.radians(col(ra1))
    x = F.cos(d2) * F.sin(dr)
    y = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dr)
    z = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(dr)
    return F.degrees(F.atan2(F.sqrt(x * x + y * y), z))


def separation_flat(ra1, dec1, ra2, dec2) -> Column:
    """Small-angle separation scaled by the cosine of the mean declination, across the RA wrap."""
    d1, d2 = col(dec1), col(dec2)
    dra = F.abs(col(ra1) - col(ra2))
    dra = F.least(dra, 360.0 - dra) * F.cos(F.radians((d1 + d2) / 2))
    dd = d1 - d2
    return F.sqrt(dra * dra + dd * dd)


def propagate(ra, dec, pmra, pmdec, epoch_from, epoch_to):
    """Position moved by its proper motion (mas/yr, RA rate already on the great circle)."""
    step = col(epoch_to) - col(epoch_from)
    moved_ra = col(ra) + F.coalesce(col(pmra), F.lit(0.0)) / 3.6e6 * step / F.cos(F.radians(col(dec)))
    moved_dec = col(dec) + F.coalesce(col(pmdec), F.lit(0.0)) / 3.6e6 * step
    return F.pmod(moved_ra, F.lit(360.0)), moved_dec


def galactic_latitude(ra, dec) -> Column:
    d, p = F.radians(col(dec)), F.radians(F.lit(POLE_DEC))
    a = F.radians(col(ra) - F.lit(POLE_RA))
    return F.degrees(F.asin(F.sin(d) * F.sin(p) + F.cos(d) * F.cos(p) * F.cos(a)))


def galactic_longitude(ra, dec) -> Column:
    d, p = F.radians(col(dec)), F.radians(F.lit(POLE_DEC))
    a = F.radians(col(ra) - F.lit(POLE_RA))
    y = F.cos(d) * F.sin(a)
    x = F.sin(d) * F.cos(p) - F.cos(d) * F.sin(p) * F.cos(a)
    return F.pmod(F.lit(POLE_LON) - F.degrees(F.atan2(y, x)), F.lit(360.0))


def unit_vector(ra, dec):
    r, d = F.radians(col(ra)), F.radians(col(dec))
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def chord(angle) -> Column:
    """Straight-line distance on the unit sphere for an angle."""
    return 2.0 * F.sin(F.radians(col(angle)) / 2)


def cartesian(ra, dec, distance):
    """Three-dimensional position; null without a positive distance."""
    d = F.when(col(distance) > 0, col(distance))
    return tuple(d * u for u in unit_vector(ra, dec))


def ecliptic_to_equatorial(lon, lat):
    e = F.radians(F.lit(OBLIQUITY))
    l, b = F.radians(col(lon)), F.radians(col(lat))
    dec = F.degrees(F.asin(F.sin(b) * F.cos(e) + F.cos(b) * F.sin(e) * F.sin(l)))
    ra = F.degrees(F.atan2(F.sin(l) * F.cos(e) - F.tan(b) * F.sin(e), F.cos(l)))
    return F.pmod(ra, F.lit(360.0)), dec


def from_sexagesimal(text, hours: bool) -> Column:
    """'HH MM SS' or 'DD MM SS' (spaces or colons); plain decimal degrees pass through."""
    t = F.trim(col(text))
    parts = F.split(t, "[ :]+")
    whole = F.abs(F.get(parts, F.lit(0)).try_cast("double"))
    rest = (
        F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)) / 60
        + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) / 3600
    )
    value = F.when(t.startswith("-"), -1.0).otherwise(1.0) * (whole + rest)
    scale = 15.0 if hours else 1.0
    return F.when(F.size(parts) >= 2, value * scale).otherwise(t.try_cast("double"))
