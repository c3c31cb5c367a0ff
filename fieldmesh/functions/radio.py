"""Radio propagation as column expressions. Loss in dB, lengths in metres, frequencies in MHz unless named otherwise."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIGHT = 299792458.0
#: Corrections by tabulated curves, against percent of sea and against slope in milliradians.
SEA_SHARE = list(range(0, 101, 10))
SEA_FAR_A = [0, 3, 5.3, 7.5, 9.2, 10.5, 11.8, 12.7, 13.5, 14.2, 14.8]
SEA_FAR_B = [0, 1.5, 2.5, 4, 5.5, 7, 9, 10.8, 12.5, 14.2, 14.8]
SEA_NEAR_A = [0, 2, 3.8, 5, 6.3, 7.5, 8.5, 9.3, 10, 10.5, 11]
SEA_NEAR_B = [0, 0.5, 1.5, 2.5, 3.5, 4.8, 6, 7.8, 9.5, 10.5, 11]
SLOPE_DOWN = [-20, -15, -10, -5, 0]
SLOPE_DOWN_10, SLOPE_DOWN_30 = [-5, -3.5, -2, -1, 0], [-18, -12.5, -8, -3.5, 0]
SLOPE_UP = [0, 5, 10, 15, 20]
SLOPE_UP_10, SLOPE_UP_30, SLOPE_UP_60 = [0, 1, 2, 2.5, 3], [0, 2.5, 4.5, 6, 7], [0, 4, 7, 10, 12]
#: Specific attenuation in woodland, (MHz, dB/m).
WOODLAND = [(30.0, 0.02), (1000.0, 0.2), (30000.0, 6.0)]


def wavelength_m(mhz: Column) -> Column:
    return F.lit(LIGHT) / (mhz * 1e6)


def within(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """c kept between bounds; null stays null, which greatest and least alone would turn into a bound."""
    out = c if lo is None else F.greatest(c, F.lit(lo))
    return F.when(c.isNotNull(), out if hi is None else F.least(out, F.lit(hi)))


def fspl_db(d: Column, wavelength: Column) -> Column:
    """Free-space loss, 0 within wavelength / 4 pi (and at the transmitter itself); null without a distance."""
    ratio = d * (4.0 * math.pi) / wavelength
    return F.when(ratio <= 1.0, 0.0).otherwise(F.log10(ratio) * 20.0)


def fspl_inverse_m(loss: Column, wavelength: Column) -> Column:
    return wavelength / (4.0 * math.pi) * F.pow(F.lit(10.0), loss / 20.0)


def horizon_radius_m(tx: Column, rx: Column) -> Column:
    return (F.sqrt(tx) + F.sqrt(rx)) * 4120.0


def fresnel_radius(wavelength: Column, d1: Column, d2: Column) -> Column:
    return F.sqrt(wavelength * d1 * d2 / (d1 + d2))


def fresnel_max_radius(mhz: Column, dist: Column) -> Column:
    """The first zone's largest radius, half way."""
    return fresnel_radius(wavelength_m(mhz), dist / 2.0, dist / 2.0)


def _log2nd(x: Column, a: float, b: float, c: float) -> Column:
    lg = F.log10(x)
    return lg * b + lg * lg * c + a


def ehata_median_db(f: Column, d_km: Column, base: Column, mobile: Column, region: Column) -> Column:
    """Median extended-Hata loss."""
    slope = lambda h: (F.lit(24.9) - F.log10(h) * 6.55)
    near, far = slope(base) * 0.1, _log2nd(base, -1.75, 3.27, -0.67) * 2.0
    at_1, at_100 = _log2nd(f, 30.52, -16.81, 4.45), _log2nd(f, 120.78, -52.71, 10.92)
    # the break point, where the two slopes meet
    bp = F.pow(F.pow(F.lit(10.0), far * 2.0 + (at_1 - at_100) / 10.0), F.lit(1.0) / (far - near))
    r = F.sqrt(F.pow(d_km * 1000.0, F.lit(2.0)) + F.pow(base - mobile, F.lit(2.0)))
    free = F.log10(f) * 20.0 + F.log10(r) * 20.0 - 27.56
    n = F.when(d_km <= bp, near).otherwise(far)
    low = lambda h: F.pow(F.log10(h * 11.75), F.lit(2.0)) * 3.2 - 4.97
    loss = at_1 + slope(base) * F.log10(bp) + n * 10.0 * F.log10(d_km / bp) + F.log10(F.lit(200.0) / base) * 13.82 + low(F.lit(3.0)) - low(mobile) + free
    return F.when(region == "Suburban", loss - _log2nd(f, 54.19, -33.30, 6.25)).otherwise(loss)


def ehata_sigma_db(f: Column, region: Column) -> Column:
    return _log2nd(f, 4.0976291, -1.2255656, 0.68350345) + F.when(region == "Suburban", 2.0).otherwise(0.0)


def blend_loss(d: Column, model: Column, fspl: Column, d_min: float = 1000.0, d_max: float = 100000.0) -> Column:
    """The model in its range, a mix with free space below, null beyond."""
    share = d / d_min
    return F.when(d < d_min, share * model + (F.lit(1.0) - share) * fspl).when(d <= d_max, model)


def blend_loss_legacy(d: Column, model: Column, fspl: Column, base: Column, d_min: float = 1000.0, cap: float = 150.0, min_base: float = 20.0) -> Column:
    share = d / d_min
    inside = (d >= d_min) & (base >= min_base)
    return F.when(inside & (model <= cap), model).when(inside, F.lit(float("inf"))).otherwise(share * model + (F.lit(1.0) - share) * fspl)


def woodland_gamma(f: Column) -> Column:
    """Interpolated between the known frequencies in logarithms, and beyond them."""
    (f0, g0), (f1, g1), (f2, g2) = WOODLAND
    leg = lambda fa, ga, fb, gb: F.pow(F.lit(10.0), (F.log10(f) - math.log10(fa)) / (math.log10(fb) - math.log10(fa)) * (math.log10(gb) - math.log10(ga)) + math.log10(ga))
    return F.when(f <= f1, leg(f0, g0, f1, g1)).otherwise(leg(f1, g1, f2, g2))


def woodland_am(f: Column) -> Column:
    return F.pow(f, F.lit(0.43)) * 1.15


def woodland_excess_db(f: Column, depth: Column) -> Column:
    am = woodland_am(f)
    return am * (F.lit(1.0) - F.exp(-within(depth, 0.0) * woodland_gamma(f) / am))


def two_ray_db(d: Column, wavelength: Column, tx: Column, rx: Column) -> tuple[Column, Column]:
    """(received power, free-space power) relative to the sent one."""
    free = F.pow(wavelength / (d * (4.0 * math.pi)), F.lit(2.0))
    wave = F.pow(F.sin(tx * rx * (2.0 * math.pi) / (wavelength * d)), F.lit(2.0))
    return F.log10(free * 4.0 * wave) * 10.0, F.log10(free) * 10.0


def link_band(db: Column) -> Column:
    return F.when((db >= 90) & (db < 120), "excellent").when((db >= 120) & (db < 130), "good").when((db >= 130) & (db <= 140), "poor")


@functools.cache
def _curve(xs: tuple[float, ...], ys: tuple[float, ...]):
    def run(at: pa.Array) -> pa.Array:
        x, y, v = np.array(xs, float), np.array(ys, float), at.cast(pa.float64()).to_numpy(zero_copy_only=False)
        k = np.clip(np.searchsorted(x, v, "right") - 1, 0, len(x) - 2)
        leg = (v - x[k]) / (x[k + 1] - x[k]) * (y[k + 1] - y[k]) + y[k]
        # not by where(v >= ...): what is no number, or null, is past the end
        return pa.array(np.where(v < x[0], y[0], np.where(v < x[-1], leg, y[-1])))

    return F.arrow_udf(run, T.DoubleType())


def curve(xs: list, ys: list, at: Column) -> Column:
    """A piecewise linear curve, flat beyond its ends. Legs are looked up in numpy: spelled out, many of them are too long to compile."""
    return _curve(tuple(xs), tuple(ys))(at)


def sea_correction_db(d_km: Column, share: Column, case: Column) -> Column:
    """By the share of sea in percent, and the end that it touches: A the receiver, B the transmitter, C else."""
    pick = lambda a, b: F.when(case == "A", curve(SEA_SHARE, a, share)).when(case == "B", curve(SEA_SHARE, b, share)).otherwise((curve(SEA_SHARE, a, share) + curve(SEA_SHARE, b, share)) / 2.0)
    near, far = pick(SEA_NEAR_A, SEA_NEAR_B), pick(SEA_FAR_A, SEA_FAR_B)
    return F.when(share <= 0, 0.0).when(d_km > 60, far).when(d_km < 30, near).otherwise(near + (far - near) * (d_km - 30.0) / 30.0)


def slope_correction_db(d_km: Column, mrad: Column) -> Column:
    m = within(mrad, -20.0, 20.0)
    between = lambda a, b, lo, hi: a + (b - a) * (d_km - lo) / (hi - lo)
    d10, d30 = curve(SLOPE_DOWN, SLOPE_DOWN_10, m), curve(SLOPE_DOWN, SLOPE_DOWN_30, m)
    u10, u30, u60 = (curve(SLOPE_UP, c, m) for c in (SLOPE_UP_10, SLOPE_UP_30, SLOPE_UP_60))
    down = F.when(d_km < 10, d10).when(d_km <= 30, between(d10, d30, 10.0, 30.0)).otherwise(d30)
    up = F.when(d_km < 10, u10).when(d_km <= 30, between(u10, u30, 10.0, 30.0)).when(d_km <= 60, between(u30, u60, 30.0, 60.0)).otherwise(u60)
    return F.when(m == 0, 0.0).when(m < 0, down).when(m > 0, up)
