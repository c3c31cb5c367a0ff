"""Spatial operators against plain versions, and how they deal crowded places."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import spatial, terrain

XY = "id long, x double, y double"


def brute_pairs(a, b, r, strict=False):
    d = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    return Counter((p[0], q[0]) for p in a for q in b if None not in p and None not in q and (d(p, q) < r if strict else d(p, q) <= r))


@pytest.mark.parametrize("kind", ["even", "crowded", "one place"])
def test_range_join_in_crowds(spark, monkeypatch, kind):
    monkeypatch.setattr(spatial, "CROWD", 20)
    monkeypatch.setattr(spatial, "SMALL", 0)
    rng = random.Random(kind)
    place = {"even": lambda: rng.uniform(-900, 900), "crowded": lambda: rng.choice([rng.uniform(-900, 900), rng.uniform(0, 9), rng.uniform(0, 0.1)]), "one place": lambda: 5.0}[kind]
    a = [(i, place(), place()) for i in range(300)] + [(900, None, 1.0)]
    b = [(i, place(), place()) for i in range(150)] + [(901, 1.0, None)]
    got = spatial.range_join(spark.createDataFrame(a, XY), spark.createDataFrame(b, XY), 100.0)
    assert Counter((r["id"], r["b_id"]) for r in got.collect()) == brute_pairs(a, b, 100.0)
    if kind != "even":
        assert got.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().count() > 2


def test_all_towers_in_one_cell_are_dealt(spark, monkeypatch):
    """Receivers are even, all towers share a cell: pairs come from many tasks, none with a large share."""
    monkeypatch.setattr(spatial, "SMALL", 0)
    monkeypatch.setattr(spatial, "CROWD", 200)
    rx = spark.range(2000).select("id", (F.col("id") * 7919 % 2000 * 1.0).alias("x"), (F.col("id") * 104729 % 2000 * 1.0).alias("y"))
    tower = spark.range(2000).select("id", (F.col("id") * 31 % 97 * 0.1 + 500).alias("x"), (F.col("id") * 57 % 89 * 0.1 + 500).alias("y"))
    out = spatial.range_join(rx, tower, 1000.0)
    by_task = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(by_task) >= 6 and max(by_task) < 0.4 * sum(by_task)
    assert sum(by_task) == out.select("id", "b_id").distinct().count()


def test_balanced_join_is_a_join(spark):
    rows = [(k % 3 if k % 2 else 7, k) for k in range(400)]
    a, b = spark.createDataFrame(rows, "k long, a long"), spark.createDataFrame(rows[:150], "k long, b long")
    want = Counter((r["a"], r["b"]) for r in a.join(b, "k").collect())
    for crowd in (10, 60, 10_000):
        assert Counter((r["a"], r["b"]) for r in spatial.balanced_join(a, b, ["k"], crowd=crowd).collect()) == want


RING = "poly_id int, ring array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def inside_or_on(x, y, r):
    c, on = 0, False
    for p, q in zip(r, r[1:], strict=False):
        x1, y1, x2, y2 = p["x"], p["y"], q["x"], q["y"]
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            c += 1
        if abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            on = True
    return on or c % 2 == 1


def star(rng, n, cx, cy, size):
    return ring([(cx + math.cos(2 * math.pi * k / n) * size * rng.uniform(0.2, 1), cy + math.sin(2 * math.pi * k / n) * size * rng.uniform(0.2, 1)) for k in range(n)])


def test_points_in_polygons_of_all_sizes(spark, monkeypatch):
    rng = random.Random(8)
    polygons = [(k, star(rng, n, rng.uniform(-50, 50), rng.uniform(-50, 50), size)) for k, (n, size) in enumerate([(3, 80), (40, 60), (300, 90), (5, 0.5), (17, 3), (900, 1000)])]
    polygons += [(10, ring([(0, 0), (0, 32), (32, 32), (32, 0)])), (11, ring([(0, 0), (8, 8), (16, 0), (16, 16), (0, 16)])), (12, ring([(4, 4), (4, 4)]))]
    points = [(k, rng.uniform(-120, 120), rng.uniform(-120, 120)) for k in range(1500)]
    points += [(5000 + k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in range(-2, 35, 2) for y in range(-2, 35, 2))]
    points += [(5000 + 19 * 19 + k, q["x"], q["y"]) for k, q in enumerate(q for _, r in polygons[:5] for q in r[:-1])] + [(9999, None, 3.0)]
    want = Counter((i, k) for i, x, y in points if x is not None for k, r in polygons if inside_or_on(x, y, r))
    p, q = spark.createDataFrame(points, XY), spark.createDataFrame(polygons, RING)
    for small in (spatial.SMALL, 0):
        monkeypatch.setattr(spatial, "SMALL", small)
        assert Counter((r["id"], r["poly_id"]) for r in spatial.points_in_polygon(p, q, "id").collect()) == want
    assert spatial.points_in_polygon(p, q.limit(0), "id").count() == 0


def test_only_points_in_touched_cells_meet_edges(spark):
    q = spark.createDataFrame([(1, ring([(0, 0), (0, 1000), (1000, 1000), (1000, 0)]))], RING)
    cells = spatial.polygon_cells(spatial._cell_edges(spatial._scaled(q))).select(F.bit_count("inside").alias("i"), F.bit_count("edge").alias("e"), F.col("inside").bitwiseAND(F.col("edge")).alias("both")).collect()
    assert sum(r["i"] for r in cells) == 14 * 14 and sum(r["e"] for r in cells) > 0 and not any(r["both"] for r in cells)


def test_grids_are_made_by_scan_lines(spark):
    rng = random.Random(2)
    polygons = [(1, ring([(0, 0), (0, 10), (10, 10), (10, 0)])), (2, ring([(0, 0), (10, 5), (0, 10)])), (3, star(rng, 12, 3, -4, 20)), (4, ring([(0, 0), (0, 8), (4, 4), (8, 8), (8, 0), (4, 3)]))]
    for n, res in ((11, None), (None, 0.75)):
        want = Counter()
        for k, r in polygons:
            xs, ys = [p["x"] for p in r], [p["y"] for p in r]
            step = res or max(max(xs) - min(xs), max(ys) - min(ys)) / (n - 1)
            nx, ny = math.floor((max(xs) - min(xs)) / step + 1e-9), math.floor((max(ys) - min(ys)) / step + 1e-9)
            for i in range(nx + 1):
                for j in range(ny + 1):
                    x, y = (min(xs) + max(xs)) / 2 + (i - nx / 2) * step, (min(ys) + max(ys)) / 2 + (j - ny / 2) * step
                    if inside_or_on(x, y, r):
                        want[k, i, j, round(x, 6), round(y, 6)] += 1
        got = spatial.build_grid(spark.createDataFrame(polygons, RING), n=n, res=res)
        assert Counter((r["poly_id"], r["i"], r["j"], round(r["x"], 6), round(r["y"], 6)) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


def test_roughness_by_moments(spark):
    rng = random.Random(3)
    grid = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(40)] + [(98, 25.0, 25.0), (99, 5000.0, 0.0)]
    points = [(rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([None, 1e6 + rng.random()])) for _ in range(1200)] + [(25.0 + 10, 25.0, 1e6), (25.0, 25.0 - 10, 1e6 + 0.5)]
    radii = (10.0, 33.0)
    got = {(r["rx_id"], r["radius"]): r for r in terrain.roughness(spark.createDataFrame(grid, "rx_id long, x double, y double"), spark.createDataFrame(points, "x double, y double, z double"), radii).collect()}
    for i, x, y in grid:
        for r in radii:
            own = [z for a, b, z in points if z is not None and math.sqrt((a - x) ** 2 + (b - y) ** 2) <= r]
            assert ((i, r) in got) == bool(own)
            if own:
                mean = sum(own) / len(own)
                assert got[i, r]["n"] == len(own) and got[i, r]["msd"] == pytest.approx(sum((z - mean) ** 2 for z in own) / len(own), abs=1e-7)


def test_pyramid_reads_the_raster_without_copies(spark):
    """Only cells that a disc's edge crosses meet points, and a point is in one of them."""
    grid = spark.createDataFrame([(1, 50.0, 50.0)], "rx_id long, x double, y double")
    cover = terrain.disc_cover(grid, (40.0,), 2.0).collect()
    area = {}
    for r in cover:
        h = 2.0 * 2 ** r["level"]
        for i in range(2 ** r["level"]):
            for j in range(2 ** r["level"]):
                at = (r["cx"] * 2 ** r["level"] + i, r["cy"] * 2 ** r["level"] + j)
                assert at not in area
                area[at] = r["inner"]
        if r["inner"]:
            assert max(math.hypot(a - 50, b - 50) for a in (r["cx"] * h, r["cx"] * h + h) for b in (r["cy"] * h, r["cy"] * h + h)) <= 40
    assert len({r["level"] for r in cover}) > 2 and sum(not v for v in area.values()) < 0.3 * len(area)
