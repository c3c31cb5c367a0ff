"""Corrections from profiles against plain versions of the formulas, and what null does."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmesh.functions import geo, radio
from fieldmesh.operators import links, terrain


def share(values, q):
    """Linear between the points of the empirical distribution, which begins at (lowest, 0)."""
    s = sorted(values)
    points = [(s[0], 0.0)] + [(v, sum(w <= v for w in s) / len(s)) for v in sorted(set(s))]
    for (v0, p0), (v1, p1) in zip(points, points[1:], strict=False):
        if p0 <= q <= p1:
            return v0 + (v1 - v0) * (q - p0) / (p1 - p0)


def plain_hilly(profile, dist):
    step = dist / (len(profile) - 1)
    near = [z for k, z in enumerate(reversed(profile)) if k * step <= 10_000 + 1e-6 and z is not None]
    h10, h90, h50 = share(near, 0.9), share(near, 0.1), share(near, 0.5)
    dh = h10 - h90
    if dist < 10_000:
        dh = dh * dist * (1 - 0.8 * math.exp(-0.2)) / (1 - 0.8 * math.exp(-0.02 * dist))
    if dh < 10:
        return dh, 0.0, 0.0, 0.0
    dh = min(dh, 500.0)
    lg = math.log10(dh)
    kh, most, end = 1.507213 - 8.458676 * lg + 6.102538 * lg * lg, -11.728795 + 15.544272 * lg - 1.8154766 * lg * lg, profile[-1]
    if end <= h90:
        khf = -most
    elif end < h50:
        khf = -most + most * (end - h90) / (h50 - h90)
    elif end < h10:
        khf = most * (end - h50) / (h10 - h50)
    else:
        khf = most
    return dh, kh, khf, kh - khf


def fit(z):
    n = len(z)
    mx, mz = (n - 1) / 2, sum(z) / n
    return sum((i - mx) * (v - mz) for i, v in enumerate(z)) / sum((i - mx) ** 2 for i in range(n))


def line(xs, ys, x):
    for k in range(len(xs) - 1):
        if xs[k] <= x <= xs[k + 1]:
            return ys[k] + (ys[k + 1] - ys[k]) * (x - xs[k]) / (xs[k + 1] - xs[k])


def plain_slope(profile, dist):
    d, n = dist / 1000, len(profile)
    if not any(profile) or d < 5:
        return None, 0.0
    step = dist / (n - 1)
    angles = []
    for k in range(5, min(10, math.floor(d)) + 1):
        tail = [z for j, z in enumerate(profile) if (n - 1 - j) * step <= k * 1000 + 1e-6]
        angles.append(math.atan(fit(tail) / step) - math.atan(fit(profile) / step))
    pick = max(angles) if all(a > 0 for a in angles) else min(angles) if all(a < 0 for a in angles) else angles[0]
    m = max(-20.0, min(20.0, pick * 1000))
    down, up = [-20, -15, -10, -5, 0], [0, 5, 10, 15, 20]
    if m == 0:
        return m, 0.0
    if m < 0:
        a, b = line(down, [-5, -3.5, -2, -1, 0], m), line(down, [-18, -12.5, -8, -3.5, 0], m)
        return m, a if d < 10 else line([10, 30], [a, b], d) if d <= 30 else b
    a, b, c = line(up, [0, 1, 2, 2.5, 3], m), line(up, [0, 2.5, 4.5, 6, 7], m), line(up, [0, 4, 7, 10, 12], m)
    return m, a if d < 10 else line([10, 30], [a, b], d) if d <= 30 else line([30, 60], [b, c], d) if d <= 60 else c


def profiles():
    rng = random.Random(6)
    out = []
    for k, dist in enumerate([800.0, 4999.0, 5000.0, 5001.0, 7300.0, 9999.0, 10_000.0, 14_500.0, 30_000.0, 45_000.0, 61_000.0] * 4):
        n = rng.choice([12, 50, 101, 202])
        tilt = rng.choice([-0.01, 0.0, 0.02]) * dist / n
        kind = k % 4
        z = [tilt * i + (rng.uniform(0, 300) if kind == 0 else rng.choice([0.0, 20.0, 40.0]) if kind == 1 else i % 7 * 3.0 if kind == 2 else 0.004 * i * i) for i in range(n)]
        out.append((k, dist, z))
    return [*out, (97, 20_000.0, [0.0] * 50), (98, 20_000.0, [5.0] * 50), (99, 3000.0, [float(i) for i in range(20)])]


def test_corrections_are_exact(spark):
    rows = profiles()
    df = spark.createDataFrame(rows, "id long, dist_m double, profile array<double>")
    hilly = {r["id"]: r for r in terrain.rolling_hilly(df).collect()}
    slope = {r["id"]: r for r in terrain.general_slope(df).collect()}
    for k, dist, z in rows:
        got = tuple(hilly[k][c] for c in ("delta_h_m", "kh_db", "khf_db", "krh_db"))
        assert got == pytest.approx(plain_hilly(z, dist), abs=1e-9), k
        mrad, db = plain_slope(z, dist)
        assert slope[k]["slope_db"] == pytest.approx(db, abs=1e-7), k
        assert (slope[k]["slope_mrad"] is None) == (mrad is None) and (mrad is None or slope[k]["slope_mrad"] == pytest.approx(mrad, abs=1e-7))
    assert slope[99]["slope_db"] == 0.0 and slope[97]["slope_db"] == 0.0
    text = terrain.rolling_hilly(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in text  # no array inside an array: one sort, a few linear looks


def test_unknown_heights(spark):
    df = spark.createDataFrame([(1, 20_000.0, [None, 5.0, 80.0, None, 3.0, 60.0]), (2, 20_000.0, [None] * 6), (3, None, [1.0, 2.0, 3.0])], "id long, dist_m double, profile array<double>")
    hilly = {r["id"]: r["krh_db"] for r in terrain.rolling_hilly(df).collect()}
    assert hilly[1] == pytest.approx(plain_hilly([None, 5.0, 80.0, None, 3.0, 60.0], 20_000.0)[3]) and hilly[2] is None and hilly[3] is None
    assert [r["slope_db"] for r in terrain.general_slope(df).orderBy("id").collect()] == [None] * 3


def test_null_stays_null(spark):
    n = F.lit(None).cast("double")
    one = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    w = radio.wavelength_m(F.lit(1900.0))
    for c in (
        radio.fspl_db(n, w), radio.woodland_excess_db(F.lit(1900.0), n), radio.slope_correction_db(F.lit(5.0), n), radio.within(n, 0.0, 1.0), geo.band_of(n),
        geo.rect_from_corners(n, F.lit(0.0), F.lit(1.0), F.lit(1.0)), geo.rect_from_centre(F.lit(0.0), n, F.lit(1.0), F.lit(1.0)),
    ):
        assert one(c) is None
    assert one(radio.fspl_db(F.lit(0.0), w)) == 0.0
    df = spark.createDataFrame([(None, 3.0, 120.0, 1.0, None, [1.0, 2.0])], "blockage_dist_m double, terrain_dist_m double, coverage_db double, rx_alt_m double, tx_alt_m double, profile array<double>")
    v = links.with_vegetation(df, F.lit(1900.0)).first()
    assert v["veg_dist_m"] is None and v["loss_with_veg_db"] is None
    assert links.orient_link(df).first()["tx_alt_m"] is None


def test_receiver_without_place_has_no_loss(spark):
    from fieldmesh.operators.towers import optimistic_fspl

    rx = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 3.0)], "rx_id long, x double, y double")
    tower = spark.createDataFrame([(5, 30.0, 40.0)], "tower_id long, x double, y double")
    got = {r["rx_id"]: (r["nearest_tower_id"], r["dist_m"], r["fspl_db"]) for r in optimistic_fspl(rx, tower, 1900.0, 10.0).collect()}
    assert got[2] == (None, None, None) and got[1][:2] == (5, 50.0)
