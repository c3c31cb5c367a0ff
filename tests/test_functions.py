"""Exact examples of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from fieldmesh.functions import geo, radio
from fieldmesh.operators import measure, runs


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("line", "point", "expected"),
    [(((0, 0), (1, 0)), (0, 0), 0), (((0, 0), (1, 0)), (0, 1), 1), (((0, 0), (1, 0)), (2, 2), 2), (((0, 0), (1, 1)), (-1, -1), 0), (((0, 0), (1, 1)), (0, 1), 0.70710678)],
)
def test_point_to_line(spark, line, point, expected):
    xs = [F.lit(float(v)) for p in (point, *line) for v in p]
    assert value(spark, geo.dist_to_line(*xs)) == pytest.approx(expected, abs=1e-7)


def test_great_circle(spark):
    a = [F.lit(float(v)) for v in (-43, 172, -44, 171)]
    assert value(spark, geo.haversine_km(*a)) == pytest.approx(137.365669065197, abs=1e-9)
    assert value(spark, geo.pythag_km(*a)) == pytest.approx(137.368179013869, abs=1e-9)
    b = [F.lit(float(v)) for v in (-43, 172, 20, -108)]
    assert value(spark, geo.haversine_km(*b)) == pytest.approx(10734.8931427602, abs=1e-6)
    assert value(spark, geo.pythag_km(*b)) == pytest.approx(31303.4535270825, abs=1e-6)


def test_free_space(spark):
    w = radio.wavelength_m(F.lit(1900.0))
    assert value(spark, radio.fspl_db(F.lit(5.0), w)) == pytest.approx(52.002255, abs=1e-5)
    assert value(spark, radio.fspl_inverse_m(radio.fspl_db(F.lit(777.0), w), w)) == pytest.approx(777.0)
    assert value(spark, radio.fspl_db(F.lit(0.001), w)) == 0


def test_timestamp_and_names(spark):
    assert str(value(spark, measure.to_utc(F.lit("2022-08-08T09:40:13.642-0600")))) == "2022-08-08 15:40:13.642000"
    assert value(spark, runs.parse_run_name(F.lit("simState_HostName_node7.mat"))) == "node7"
    assert value(spark, runs.human_duration(F.lit(3900.0))) == "About 1 hour and 5 minutes."
    assert value(spark, measure.carrier_bucket(F.lit("Verizon Wireless"))) == "Verizon"


def test_unknown_carrier_is_an_error(spark):
    with pytest.raises(Exception, match="unknown carrier"):
        value(spark, measure.carrier_bucket(F.lit("Other")))


def test_curves(spark):
    assert value(spark, radio.sea_correction_db(F.lit(70.0), F.lit(15.0), F.lit("A"))) == pytest.approx(4.15)
    assert value(spark, radio.slope_correction_db(F.lit(5.0), F.lit(-30.0))) == -5


def test_tile_over_several_projections(spark):
    from fieldmesh.operators.raster import assign_tile_multi_crs

    ring = lambda w: [{"lat": a, "lon": w + b} for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0))]
    schema = "tile int, lat0 double, lon0 double, scale double, false_x double, false_y double, ring array<struct<lat:double,lon:double>>"
    tiles = [(1, 0.0, 9.0, 0.9996, 5e5, 0.0, ring(10.0)), (2, 0.5, 15.0, 1.0, 0.0, 10.0, ring(11.5))]
    places = spark.createDataFrame([(1, 0.5, 10.5), (2, 0.5, 11.2), (3, 0.9, 12.4), (4, None, 10.5)], "id int, lat double, lon double")
    got = assign_tile_multi_crs(places, spark.createDataFrame(tiles, schema), "id")
    assert sorted((r["id"], r["tile"]) for r in got.collect()) == [(1, 1), (2, None), (3, 2), (4, None)]
    both = spark.createDataFrame([*tiles, (3, 0.0, 15.0, 1.0, 0.0, 0.0, ring(10.2))], schema)
    with pytest.raises(Exception, match="two tiles"):
        assign_tile_multi_crs(places, both, "id").collect()
