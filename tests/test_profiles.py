"""Profiles and what is told from them: a batch of links at a time, without moving links or samples."""

import functools
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import links, raster, terrain
from fieldmesh.plans.queries import QUERIES

LINKS = "tower_id long, rx_id long, tx_x double, tx_y double, x double, y double, dist_m double"
PROFILED = ("link_profiles", "link_blockage", "blockage_variants", "oriented_links", "sea_shares", "rolling_hilly", "general_slope")


def cells(spark):
    rng = random.Random(3)
    # some cells are not there, and the heights of some are not known
    rows = [(r, c, None if (r + 2 * c) % 11 == 0 else rng.uniform(0, 90)) for r in range(40) for c in range(25) if (r * c) % 17 != 5]
    return spark.createDataFrame(rows, "row long, col long, z double")


def some_links(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        a, b, x, y = (rng.choice([rng.uniform(-30, 420), float(rng.randrange(0, 400, 10))]) for _ in range(4))
        rows.append((k % 7, k, a, b, x, y, math.dist((a, b), (x, y))))
    return spark.createDataFrame([*rows, (1, 900, 5.0, 5.0, 5.0, 100.0, 95.0)], LINKS)


@pytest.mark.parametrize("held", [raster.HELD, 0])
def test_profiles_beside_missing_cells(spark, monkeypatch, held):
    monkeypatch.setattr(raster, "HELD", held)
    monkeypatch.setattr(raster, "TOGETHER", 500)
    p = raster.profiles(some_links(spark), cells(spark), 10.0, 7.0, side=8).collect()
    z = {(r["row"], r["col"]): r["z"] for r in cells(spark).collect()}
    assert len(p) == 151

    def height(x, y):
        c, r = math.floor(x / 10.0), math.floor(y / 10.0)
        tx, ty = x / 10.0 - c, y / 10.0 - r
        along = lambda a, b, t: a if t == 0 else None if a is None or b is None else a * (1 - t) + b * t
        return along(along(z.get((r, c)), z.get((r, c + 1)), tx), along(z.get((r + 1, c)), z.get((r + 1, c + 1)), tx), ty)

    known = 0
    for r in p:
        n = max(math.ceil(r["dist_m"] / 7.0), 10)
        want = [height(r["tx_x"] + (r["x"] - r["tx_x"]) * (i / (n - 1)), r["tx_y"] + (r["y"] - r["tx_y"]) * (i / (n - 1))) for i in range(n)]
        assert [v is None for v in r["profile"]] == [v is None for v in want]
        assert [v for v in r["profile"] if v is not None] == pytest.approx([v for v in want if v is not None], abs=1e-12)
        assert r["n_known"] == sum(v is not None for v in want)
        known += r["n_known"]
    assert known > 500


@pytest.mark.parametrize("held", [raster.HELD, 0])
def test_links_of_equal_keys_share_a_profile(spark, monkeypatch, held):
    monkeypatch.setattr(raster, "HELD", held)
    grid = spark.range(1600).select(F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), F.col("id").cast("double").alias("z"))
    rows = [(1, 1, 0.0, 50.0, 300.0, 50.0, 300.0)] * 2 + [(1, 2, 0.0, 50.0, 300.0, 50.0, 300.0), (None, 1, 0.0, 0.0, 9.0, 9.0, 12.7), (1, None, 0.0, 0.0, 9.0, 9.0, 12.7)]
    one = [200.0 + i * 300.0 / 29 / 10 for i in range(30)]
    got = sorted((r["tower_id"], r["rx_id"], r["n_known"], r["profile"]) for r in raster.profiles(spark.createDataFrame(rows, LINKS), grid, 10.0, 10.0, side=8).collect())
    assert [g[:3] for g in got] == [(1, 1, 60), (1, 1, 60), (1, 2, 30)]
    assert got[2][3] == pytest.approx(one)
    # piece by piece, each from block to block
    first = sum(v < 208.0 for v in one)
    assert got[0][3] == got[1][3] and got[0][3][: 2 * first] == pytest.approx(one[:first] * 2) and sorted(got[0][3]) == pytest.approx(sorted(one * 2))


@pytest.mark.parametrize("name", PROFILED)
def test_no_sample_and_no_profile_is_moved(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    # receivers are dealt out before they are linked
    assert text.count("Exchange hashpartitioning") == 1 and "collect_list" not in text
    # arrays are gone through by numpy, but for the rare profile with a gap
    assert text.count("transform(") <= 1 and "aggregate(" not in text


def fresnel(w, a, b):
    return math.sqrt(w * a * b / (a + b))


def plain_flags(z, dist, tx, rx, w, ratio, exact):
    out, n = [], len(z)
    if tx is None:
        return [None] * (n - 2)
    full = math.hypot(dist, tx - rx)
    for i in range(1, n - 1):
        d = i * (dist / (n - 1))
        if z[i] is None:
            out.append(None)
            continue
        off = abs(dist * (z[i] - tx) - (rx - tx) * d) / full
        if exact:
            d1 = math.sqrt(max(d * d + (z[i] - tx) ** 2 - off * off, 0.0))
            near = off < fresnel(w, full / 2, full / 2) * ratio and dist - d1 >= 0 and off < fresnel(w, d1, dist - d1) * ratio
        else:
            near = off <= fresnel(w, math.hypot(d, z[i] - tx), math.hypot(dist - d, z[i] - rx)) * ratio
        out.append(z[i] >= d / dist * (rx - tx) + tx or near)
    return out


def test_flags_of_samples(spark):
    rng = random.Random(8)
    rows = [(k, [None if k % 9 == 0 and rng.random() < 0.3 else rng.uniform(0, 70) for _ in range(rng.choice([3, 10, 60]))], rng.uniform(300, 30_000), rng.uniform(20, 90), rng.uniform(20, 90)) for k in range(60)]
    rows += [(60, [None] * 5, 500.0, 30.0, 30.0), (61, [1.0, float("nan"), 2.0], 500.0, 30.0, 30.0), (62, [1.0] * 4, 500.0, None, 30.0), (63, None, 500.0, 30.0, 30.0)]
    df = spark.createDataFrame(rows, "id long, profile array<double>, dist_m double, tx double, rx double")
    e = [F.col("profile"), F.col("dist_m"), F.col("tx"), F.col("rx"), F.lit(0.15)]
    a, b, c = links.classify_samples(*e), links.approximate_samples(*e), links.approximate_samples(*e, 0.2)
    got = {r["id"]: r for r in df.select("id", a.alias("a"), b.alias("b"), c.alias("c")).collect()}
    for k, z, dist, tx, rx in rows[:61] + rows[62:63]:
        assert got[k]["a"] == plain_flags(z, dist, tx, rx, 0.15, 0.6, True), k
        assert got[k]["b"] == plain_flags(z, dist, tx, rx, 0.15, 0.6, False) and got[k]["c"] == plain_flags(z, dist, tx, rx, 0.15, 0.2, False), k
    assert got[61]["a"] == got[61]["b"] == [True] and got[63]["a"] is None
    assert sum(True in got[k]["a"] and False in got[k]["a"] for k in range(60)) > 10
    dist, loss = links.blockage(F.col("f"), *e[1:])
    share = {r["id"]: (r["dist"], r["loss"]) for r in df.withColumn("f", a).select("id", dist.alias("dist"), loss.alias("loss")).collect()}
    for k, z, d, tx, rx in rows[:60]:
        f = plain_flags(z, d, tx, rx, 0.15, 0.6, True)
        if all(v is None for v in f):
            assert share[k] == (None, None)
        else:
            assert share[k][0] == pytest.approx(d * sum(v is True for v in f) / len(f)) and (share[k][1] is None) == any(f)
    assert share[60] == share[62] == share[63] == (None, None)
    sums = df.select("id", links.sum_heights(F.col("profile")).alias("s"))
    assert {r["id"]: r["s"] for r in sums.collect() if r["id"] != 61} == {k: None if z is None or None in z else functools.reduce(operator.add, z, 0.0) for k, z, *_ in rows if k != 61}


def test_sea_under_a_level(spark):
    rows = [(1, 10_000.0, [3.0, 30.0, 30.0, 25.0, 19.9]), (2, 10_000.0, [30.0, 40.0, 20.0]), (3, 10_000.0, [None, 0.0, 50.0]), (4, 10_000.0, None)]
    df = spark.createDataFrame(rows, "id long, dist_m double, profile array<double>")
    got = {r["id"]: (r["sea_pct"], r["sea_case"]) for r in terrain.sea_share(df, 20.0).collect()}
    assert got == {1: (pytest.approx(50.0), "A"), 2: (0.0, None), 3: (pytest.approx(50.0), "C"), 4: (None, "C")}
    low = df.withColumn("profile", F.transform("profile", lambda z: F.when(z < 20, 0.0).otherwise(z)))
    assert sorted(map(str, terrain.sea_share(low).drop("profile").collect())) == sorted(map(str, terrain.sea_share(df, 20.0).drop("profile").collect()))


def test_curves_are_looked_up(spark):
    from fieldmesh.functions import radio

    xs, ys = [-20, -15, -10, -5, 0], [-18, -12.5, -8, -3.5, 1]
    rows = [-30.0, -20.0, -17.3, -15.0, -5.0, -0.1, 0.0, 3.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i long, v double")
    got = [r["c"] for r in df.select("i", radio.curve(xs, ys, F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [-18.0, -18.0, (-17.3 + 20) / 5 * 5.5 - 18, -12.5, -3.5, (-0.1 + 5) / 5 * 4.5 - 3.5, 1.0, 1.0, 1.0, 1.0]
    p = spark.createDataFrame([(1, 20_000.0, [1.0, 5.0, 9.0, 60.0])], "id long, dist_m double, profile array<double>")
    # a leg of a curve in the plan would be a comparison with its end
    assert terrain.general_slope(p)._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 20
