"""Raster blocks, stored blocks and tile bookkeeping."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import raster

RES = 10.0


def cells(n=90, m=70):
    rng = random.Random(1)
    return {(r, c): (None if rng.random() < 0.1 else rng.uniform(0, 50)) for r in range(n) for c in range(m) if rng.random() < 0.9}


@pytest.fixture(scope="module")
def table(spark):
    own = cells()
    return own, spark.createDataFrame([(r, c, v) for (r, c), v in own.items()], "row long, col long, z double")


def samples(n=400):
    rng = random.Random(2)
    return [(k, rng.uniform(-40, 740), rng.uniform(-40, 940)) for k in range(n)] + [(n + k, 10.0 * k, 320.0 - k % 3 * 5) for k in range(70)] + [(9999, None, 1.0)]


def plain_nearest(own, x, y):
    best = None
    half_up = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    for r in range(half_up(y / RES) - 2, half_up(y / RES) + 3):
        for c in range(half_up(x / RES) - 2, half_up(x / RES) + 3):
            if own.get((r, c)) is not None:
                q = ((x - c * RES) ** 2 + (y - r * RES) ** 2, r, c)
                best = min(best or q, q)
    return None if best is None else own[best[1:]]


def plain_bilinear(own, x, y):
    c, r = math.floor(x / RES), math.floor(y / RES)
    tx, ty = x / RES - c, y / RES - r
    along = lambda a, b, t: a if t == 0 else None if a is None or b is None else a * (1 - t) + b * t
    at = lambda i, k: own.get((r + i, c + k))
    return along(along(at(0, 0), at(0, 1), tx), along(at(1, 0), at(1, 1), tx), ty)


@pytest.mark.parametrize("side", [32, 8])
def test_lookups(spark, table, side):
    own, df = table
    pts = samples()
    s = spark.createDataFrame(pts, "id long, x double, y double")
    near = {r["id"]: r["z"] for r in raster.nearest_cell_lookup(s, df, RES, side=side).collect()}
    line = {r["id"]: r["z"] for r in raster.bilinear_lookup(s, df, RES, side=side).collect()}
    assert len(near) == len(line) == len(pts)
    for k, x, y in pts[:-1]:
        assert near[k] == plain_nearest(own, x, y), (k, x, y)
        want = plain_bilinear(own, x, y)
        assert line[k] == (None if want is None else pytest.approx(want))
    assert near[9999] is None and line[9999] is None


def test_a_sample_probes_once_and_a_cell_is_not_copied(spark, table):
    _, df = table
    s = spark.createDataFrame(samples(), "id long, x double, y double")
    text = raster.nearest_cell_lookup(s, df, RES)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate explode") == 2  # the blocks of a cell by row and by column, none of a sample
    assert raster.nearest_cell_lookup(s, df, RES).count() == s.count()
    inner = spark.range(1).select(F.lit(48).alias("row"), F.lit(48).alias("col"), F.lit(1.0).alias("z"))
    assert raster.blocks(inner).count() == 1 and raster.blocks(inner.withColumn("row", F.lit(33))).count() == 2


def test_stored_blocks_are_pruned(spark, table, tmp_path, monkeypatch):
    own, df = table
    monkeypatch.setattr(raster, "ZONE", 2)
    path = str(tmp_path / "r")
    raster.store_blocks(df, path, side=8)
    stored = raster.StoredBlocks(spark, path)
    zones = {r["path"]: r["n_blocks"] for r in stored.zones.collect()}
    assert all((tmp_path / "r" / z).is_dir() for z in zones) and sum(zones.values()) == stored.blocks.count()
    pts = samples()
    s = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r["id"]: r["z"] for r in raster.bilinear_lookup(s, stored, RES, side=8).collect()}
    want = {r["id"]: r["z"] for r in raster.bilinear_lookup(s, df, RES, side=8).collect()}
    assert got == want
    corner = s.filter("x < 60 and y < 60")
    out = raster.bilinear_lookup(corner, stored, RES, side=8)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString().lower()
    # only the corner's zone is read
    assert stored.near(raster._with_block(corner, RES, 8)).count() <= 9 * 4 < stored.blocks.count()
    assert raster.nearest_cell_lookup(corner, stored, RES, side=8).filter("z is not null").count() > 0


def test_profiles_are_the_samples_lookups(spark, table):
    from fieldmesh.operators.links import sample_profile

    _, df = table
    rows = [(1, k, 5.0 + k, 9.0, 600.0 - 7 * k, 800.0 - k, math.hypot(595.0 - 8 * k, 791.0 - k)) for k in range(20)]
    links = spark.createDataFrame(rows, "tower_id long, rx_id long, tx_x double, tx_y double, x double, y double, dist_m double")
    got = {r["rx_id"]: r["profile"] for r in raster.profiles(links, df, RES, 25.0, side=8).collect()}
    flat = sample_profile(links, 25.0).select("rx_id", F.posexplode("samples").alias("i", "p")).select("rx_id", "i", "p.x", "p.y")
    for r in raster.bilinear_lookup(flat, df, RES, side=8).collect():
        assert got[r["rx_id"]][r["i"]] == r["z"]


def test_tile_lists(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "tile string")
    good, bad = raster.split_tiles(t, spark.createDataFrame([("b",)], "tile string"))
    assert {r["tile"] for r in good.collect()} == {"a", "c"} and bad.first()["tile"] == "b"
    with pytest.raises(ValueError, match="no tile: x"):
        raster.split_tiles(t, spark.createDataFrame([("x",)], "tile string"))
    assert [r["tile"] for r in raster.every_nth(t, 2, "tile").orderBy("tile").collect()] == ["a", "c"]


CRS = "tile string, name string, method string, unit string, lat0 double, lon0 double, scale double, false_x double, false_y double"


def test_projection_votes(spark):
    row = lambda t, name, lat, unit="m": (t, name, "TM", unit, lat, -87.0, 1.0, 0.0, 0.0)
    # y is one with x by its parameters, but z is only like y: the first of a projection stands for it
    rows = [row("t1", "x", 1.0), row("t2", "y", 1.0), row("t3", "y", 2.0), row("t4", "z", 2.0), row("t5", "w", 3.0), row("t6", "w", 4.0), row("t7", "v", 3.0, "ft")]
    best = raster.vote_crs(spark.createDataFrame(rows, CRS)).first()
    assert (best["name"], best["n"]) == ("x", 2)
    rows += [row("t8", "w", 9.0)]
    best = raster.vote_crs(spark.createDataFrame(rows, CRS)).first()
    assert (best["name"], best["lat0"], best["n"]) == ("w", 3.0, 3)
    assert raster.vote_crs(spark.createDataFrame([], CRS)).count() == 0


def test_projections_within_tolerances(spark):
    names = "lat0 double, lon0 double, scale double, false_x double, false_y double"
    known = spark.createDataFrame([("east", 37.5, -85.0, 0.9999, 1e5, 25e4), ("west", 37.5, -87.0, 0.9999, 9e5, 25e4)], "crs string, " + names)
    e = (37.5, -85.0, 0.9999, 1e5, 25e4)
    off = lambda i, by: tuple(v + by * (k == i) for k, v in enumerate(e))
    tiles = [("same", *e), ("lat", *off(0, 9e-11)), ("lat2", *off(0, -2e-10)), ("scale", *off(2, -9e-9)), ("scale2", *off(2, 2e-8)), ("x", *off(3, 0.009)), ("x2", *off(3, -0.02)), ("lost", None, *e[1:]), ("gone", *[None] * 5)]
    listed = spark.createDataFrame([("old/lost.img", 37.5, -87.0, 0.9999, 9e5, 25e4)], "tile string, " + names)
    got = {r["tile"]: r["crs"] for r in raster.attach_crs(spark.createDataFrame(tiles, "tile string, " + names), known, listed).collect()}
    assert got == {"same": "east", "lat": "east", "lat2": "unknown", "scale": "east", "scale2": "unknown", "x": "east", "x2": "unknown", "lost": "west", "gone": "unknown"}
