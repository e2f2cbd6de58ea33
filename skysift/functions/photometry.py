"""Photometric relations as column expressions, with their fixed tables."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift.functions.numeric import col, polynomial

# Zero points (Jy), wavelengths (micron), default errors (mag), extinction per E(B-V).
ZERO_POINT_JY = {
    "G": 3228.75, "BP": 3552.01, "RP": 2554.95, "J": 1594.0, "H": 1024.0,
    "Ks": 666.7, "W1": 309.540, "W2": 171.787, "W3": 31.674, "W4": 8.363,
}
DEFAULT_MAG_ERROR = {
    "G": 0.003, "BP": 0.01, "RP": 0.01, "J": 0.03, "H": 0.03,
    "Ks": 0.03, "W1": 0.03, "W2": 0.03, "W3": 0.15, "W4": 0.30,
}
OTHER_MAG_ERROR = 0.05
EXTINCTION = {
    "G": 2.740, "BP": 3.374, "RP": 2.035, "J": 0.723, "H": 0.460,
    "Ks": 0.306, "W1": 0.180, "W2": 0.120, "W3": 0.058, "W4": 0.030,
}
# Main-sequence ridge (colour, absolute magnitude) and its scatter.
RIDGE = (
    (-0.3, -1.0), (0.0, 0.5), (0.3, 2.0), (0.6, 3.5), (0.8, 4.5), (1.0, 5.5), (1.3, 7.0),
    (1.5, 8.0), (1.8, 9.5), (2.2, 11.0), (2.8, 13.0), (3.5, 15.0), (4.5, 18.0),
)
RIDGE_SCATTER = 0.75
# Main-sequence polynomial, highest power first, and its linear scatter.
SEQUENCE_POLYNOMIAL = (-0.01, 0.15, -0.6, 4.2, 1.0)
SEQUENCE_SCATTER = (0.4, 0.1)
# Physical constants (SI).
PLANCK, LIGHT, BOLTZMANN = 6.62607015e-34, 2.99792458e8, 1.380649e-23
LN10 = 2.302585092994046


def _band_value(band, table: dict[str, float], default: float | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col(band))
    return found if default is None else F.coalesce(found, F.lit(default))


def mag_to_flux(mag, band) -> Column:
    return _band_value(band, ZERO_POINT_JY) * F.pow(F.lit(10.0), -0.4 * col(mag))


def flux_to_mag(flux, band) -> Column:
    f = col(flux)
    return F.when(f > 0, -2.5 * F.log10(f / _band_value(band, ZERO_POINT_JY)))


def flux_error(mag, mag_error, band) -> Column:
    return mag_to_flux(mag, band) * F.lit(LN10) * 0.4 * col(mag_error)


def default_error(band) -> Column:
    return _band_value(band, DEFAULT_MAG_ERROR, OTHER_MAG_ERROR)


def planck(wavelength_m, teff) -> Column:
    """Spectral radiance per unit frequency; the exponent is held at 500."""
    w = col(wavelength_m)
    x = F.least(F.lit(PLANCK * LIGHT / BOLTZMANN) / (w * col(teff)), F.lit(500.0))
    return F.lit(2 * PLANCK * LIGHT) / (w * w * w) / (F.exp(x) - 1.0)


def extinction(band, reddening) -> Column:
    return _band_value(band, EXTINCTION, 0.0) * col(reddening)


def extinction_concern(reddening) -> Column:
    e = col(reddening)
    return (
        F.when(e < 0.01, "NEGLIGIBLE").when(e < 0.05, "LOW").when(e < 0.3, "MODERATE")
        .when(e.isNotNull(), "HIGH")
    )


def absolute_magnitude(mag, parallax) -> Column:
    p = F.when(col(parallax) > 0, col(parallax))
    return col(mag) + 5.0 * F.log10(p) - 10.0


def ridge_magnitude(colour) -> Column:
    """Piecewise-linear main-sequence ridge; null outside its colour range."""
    c = col(colour)
    ladder = F.when(c < RIDGE[0][0], F.lit(None).cast("double"))
    for (x0, y0), (x1, y1) in pairwise(RIDGE):
        ladder = ladder.when(c <= x1, F.lit(y0) + (c - x0) / F.lit(x1 - x0) * F.lit(y1 - y0))
    return ladder


def sequence_magnitude(colour) -> Column:
    return polynomial(col(colour), SEQUENCE_POLYNOMIAL)


def sequence_scatter(colour) -> Column:
    base, slope = SEQUENCE_SCATTER
    return F.lit(base) + F.lit(slope) * F.abs(col(colour))


def on_giant_branch(colour, abs_mag) -> Column:
    c = col(colour)
    return (c >= 0.8) & (col(abs_mag) < -2.0 + 2.5 * c + 1.0)
