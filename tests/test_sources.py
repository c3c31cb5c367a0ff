"""Readers and writers round trip through files."""

import json

import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import links, runs, spatial, terrain
from fieldmesh.sources import readers, writers


def test_towers_and_stations(spark, tmp_path):
    (tmp_path / "t.csv").write_text("site,lat,long,height_m\n1,40.0,-86.0,30\n2,41.0,-87.0,\n")
    assert [tuple(r) for r in readers.read_towers(spark, str(tmp_path / "t.csv")).collect()] == [(40.0, -86.0, 30.0), (41.0, -87.0, None)]
    (tmp_path / "s.csv").write_text("id,name,latitude,longitude\n1,a,1,2\n3,b,1,2\n")
    with pytest.raises(ValueError, match="ids"):
        readers.read_stations(spark, str(tmp_path / "s.csv"), check_ids=True)


def test_rsrp_generations(spark, tmp_path):
    (tmp_path / "old.csv").write_text("timestamp,carrier,latitude,longitude,lte_primary_rsrp\nx,AT&T,1,2,-90\n")
    (tmp_path / "new.csv").write_text("timestamp,carrier,latitude,longitude,primary/other*,rsrp\nx,AT&T,1,2,Primary,-91\nx,AT&T,1,2,other,-92\n")
    assert [readers.read_rsrp(spark, str(tmp_path / f)).first()["rsrp_dbm"] for f in ("old.csv", "new.csv")] == [-90.0, -91.0]
    assert readers.read_rsrp(spark, str(tmp_path / "new.csv")).count() == 1
    assert sorted(r["rsrp_dbm"] for r in readers.read_rsrp(spark, str(tmp_path)).collect()) == [-91.0, -90.0]
    (tmp_path / "bad.csv").write_text("timestamp,carrier,latitude,longitude,level\nx,AT&T,1,2,-90\n")
    with pytest.raises(ValueError, match="neither"):
        readers.read_rsrp(spark, str(tmp_path))


def test_receivers_and_raster(spark, tmp_path):
    (tmp_path / "rx.csv").write_text("gid,lon,lat,height_m\n7,-86.5,40.5,1.5\n")
    assert tuple(readers.read_rx_points(spark, str(tmp_path / "rx.csv")).first()) == (7, -86.5, 40.5, 1.5)
    cells = spark.createDataFrame([("b", 0, 0, 0.0, 0.0, 1.0, 1.0), ("a", 0, 1, 5.0, 0.0, 2.0, 1.0), ("b", 1, 0, 0.0, 5.0, 3.0, 1.0)], readers.RASTER)
    cells.write.partitionBy("tile").parquet(str(tmp_path / "cells"))
    back = readers.read_raster(spark, str(tmp_path / "cells"))
    assert [tuple(r) for r in readers.raster_tiles(back).orderBy("tile_no").collect()] == [(1, "a", 1), (2, "b", 2)]
    assert back.filter("tile = 'a'").select("x", "z").collect() == [(5.0, 2.0)]


def test_one_zone(spark):
    ring = lambda *xs: [{"x": x, "y": 40.0 + i} for i, x in enumerate(xs)]
    schema = "poly_id string, ring array<struct<x:double,y:double>>"
    assert readers.one_zone(spark.createDataFrame([("in", ring(-86.0, -85.0, -84.5, -86.0))], schema)).count() == 1
    with pytest.raises(Exception, match="crosses zones: over"):
        readers.one_zone(spark.createDataFrame([("over", ring(-86.0, -83.0, -84.5, -86.0))], schema)).count()


def test_speedtests(spark, tmp_path):
    (tmp_path / "__MACOSX").mkdir()
    cell = {"telephony": {"connection_type": "cell"}}
    leg = {"bytes_transferred": 1000.0, "duration": 8000.0, "environment": {"beginning": cell, "end": cell | {"location": {"lat": 1.0, "lon": 2.0}}}}
    (tmp_path / "a.json").write_text(json.dumps({"carrier_name": "AT&T", "tests": {"download": leg, "upload": leg}}))
    b = {"testResult": 5.0, "latitude": 3.0, "longitude": 4.0, "isWiFi": True}
    (tmp_path / "b.json").write_text(json.dumps({"device_environment": {"carrier_name": "Verizon"}, "tests": {"Download": b | {"referenceNumber": "r1"}, "Upload": b}}))
    (tmp_path / "c.json").write_text(json.dumps({"tests": {}}))
    (tmp_path / "__MACOSX" / "a.json").write_text(json.dumps({"tests": {"download": leg}}))
    good, bad = readers.read_speedtests(spark, str(tmp_path))
    rows = {r["test_id"]: r for r in good.collect()}
    assert bad.count() == 1 and set(rows) == {"a", "r1"}
    assert rows["a"]["down_bps"] == pytest.approx(1e6) and rows["a"]["cellular"] and not rows["r1"]["cellular"] and rows["r1"]["up_lat"] == 3.0
    assert rows["r1"]["down_bps"] == 5e6 and rows["r1"]["carrier"] == "Verizon" and rows["a"]["down_lon"] == 2.0
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_boundary_and_map_export(spark, tmp_path):
    f = {"id": "p", "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [0.0, 4.0], [4.0, 4.0], [0.0, 0.0]]]}}
    (tmp_path / "b.json").write_text(json.dumps({"features": [f, {"id": "q", "geometry": {"type": "Point"}}]}))
    assert spatial.polygon_area_km2(readers.read_boundaries(spark, str(tmp_path / "b.json"))).first()["area_km2"] == pytest.approx(8e-6)
    m = spark.createDataFrame([(1.0, 2.0, 1.5, 100.0, 3.0)], "lon double, lat double, rx_height_m double, ehata_path_loss_db double, accumulate_blockage_dist_m double")
    writers.write_maps(m, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True, inferSchema=True).columns[:3] == ["lon", "lat", "install_height_m"]


def test_grid_and_terrain(spark):
    p = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 10.0}, {"x": 10.0, "y": 10.0}, {"x": 10.0, "y": 0.0}, {"x": 0.0, "y": 0.0}])], "poly_id int, ring array<struct<x:double,y:double>>")
    assert spatial.build_grid(p, n=11).count() == 121
    df = spark.createDataFrame([(20000.0, [float(i % 37) * 2 for i in range(201)])], "dist_m double, profile array<double>")
    h = terrain.rolling_hilly(df).first()
    assert h["delta_h_m"] == pytest.approx(58.0, abs=6) and h["krh_db"] == pytest.approx(h["kh_db"] - h["khf_db"])
    rising = spark.createDataFrame([(20000.0, [0.1 * i for i in range(201)])], "dist_m double, profile array<double>")
    assert terrain.general_slope(rising).first()["slope_mrad"] == pytest.approx(0.0, abs=1e-6)


def test_tower_order_does_not_matter(spark):
    from fieldmesh.operators.maps import combine_towers

    rows = [(1.5, 1, float(v)) for v in (5, 3, 9)]
    a, b = (combine_towers(spark.createDataFrame(r, "rx_height_m double, rx_id long, loss_db double")).collect() for r in (rows, rows[::-1]))
    assert a == b and a[0]["loss_db"] == 3.0


def test_log(spark, tmp_path):
    (tmp_path / "l.txt").write_text("[2020/01/01 22:25:43] Effective cellular tower #1/2 ...\n[2020/01/01 22:36:13] Finished cellular tower #1/2\nother\n")
    d = runs.log_durations(readers.read_run_log(spark, str(tmp_path / "l.txt")))
    assert [tuple(r) for r in d.select("tower", "seconds").collect()] == [(1, 630.0)]
    assert runs.log_totals(d).first()["span_s"] == 630.0


def test_profile_ends(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 10.0)], "tx_x double, tx_y double, x double, y double, dist_m double")
    s = links.sample_profile(df, 3.0, 2).first()["samples"]
    assert (len(s), s[0]["x"], s[-1]["x"]) == (4, 0.0, 10.0)


def test_receiver_lists_and_run_names(spark, tmp_path):
    (tmp_path / "l.csv").write_text("name,RXLatitudes,RXLongitudes\na,40.1,-105.2\nb,,-105.3\n")
    assert [tuple(r) for r in readers.read_rx_list(spark, str(tmp_path / "l.csv")).collect()] == [(40.1, -105.2), (None, -105.3)]
    names = ["x/Simulation_Tipp_2_Carrier_1900MHz_NGrid_128_LiDAR_IN_DSM_2019", "Simulation_Acre_Carrier_915MHz_LiDAR_USGS", "other"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(runs.parse_run_folder(F.col("n")).alias("a")).collect()
    assert [r["a"] and tuple(r["a"]) for r in got] == [("Tipp_2", 1900.0, 128, "IN_DSM_2019"), ("Acre", 915.0, None, "USGS"), None]


def read_csv(spark, path):
    return spark.read.csv(str(path), header=True, inferSchema=True)


def test_all_exports_are_read_back(spark, tmp_path):
    m = spark.createDataFrame([(1.0, 2.0, 3.0, 105.5), (1.0, 2.0, 1.5, 110.0), (4.0, 5.0, 1.5, None)], "lon double, lat double, rx_height_m double, loss_with_veg_db double")
    writers.write_veg_map(m, str(tmp_path / "veg"))
    assert sorted(tuple(r) for r in read_csv(spark, tmp_path / "veg").fillna(-1).collect()) == [(2.0, 1.0, 110.0), (5.0, 4.0, -1.0)]
    assert read_csv(spark, tmp_path / "veg").columns == ["Lat", "Lon", "PathLossWithVegInDb"]
    writers.write_grid_geo(spark.createDataFrame([(1.0, 2.0, 200.0, 210.0)], "lon double, lat double, ele double, z double"), str(tmp_path / "geo"))
    assert read_csv(spark, tmp_path / "geo").columns == ["lon", "lat", "ele_usgs_m", "lidar_z_m"] and tuple(read_csv(spark, tmp_path / "geo").first()) == (1.0, 2.0, 200.0, 210.0)
    writers.write_coverage_ratio(spark.createDataFrame([(1.5, 0.25)], "rx_height_m double, ratio double"), str(tmp_path / "ratio"))
    assert tuple(read_csv(spark, tmp_path / "ratio").first()) == (1.5, 0.25)
    writers.write_speedtests(spark.createDataFrame([("a", True), ("b", False)], "test_id string, cellular boolean"), str(tmp_path / "speed"))
    assert read_csv(spark, tmp_path / "speed" / "all").count() == 2 and read_csv(spark, tmp_path / "speed" / "cellular").first()["test_id"] == "a"
    writers.write_profile(spark.createDataFrame([(40.0, -86.0, 7.0)], "lat double, lon double, z double"), str(tmp_path / "p"))
    assert read_csv(spark, tmp_path / "p").columns == ["lat", "lon", "zInM"]
    one = spark.createDataFrame([(40.12345678, -86.0, 30.0, 40.1, -86.1, 1.5, 1234.56789012, 101.0)], "txLat double, txLon double, txAntennaHeightM double, rxLat double, rxLon double, rxAntennaHeightM double, txLocToRxLocDistM double, pathLossDb double")
    writers.write_link_eval(one, str(tmp_path / "link"))
    assert tuple(read_csv(spark, tmp_path / "link").first())[::6] == (40.123457, 1234.56789)
    point = {c: float(i) for i, c in enumerate(writers.POINT_COLUMNS) if c not in ("dist_2d_m", "dist_3d_m")} | {"tx_x": 5.0, "tx_y": 9.0, "tx_height_m": 3.0}
    rows = writers.point_rows(spark.createDataFrame([point]))
    writers.write_point_results(rows, str(tmp_path / "points"))
    back = read_csv(spark, tmp_path / "points")
    assert tuple(back.columns) == writers.POINT_COLUMNS and back.first()["dist_2d_m"] == pytest.approx(3.0)


def test_tracks_are_cut_into_pieces(spark, tmp_path):
    from fieldmesh.operators import measure

    rows = [(d, 0, t, t, -100.0 - d * 30, 40.0 + t, -86.0) for d in (1, 2) for t in range(7 if d == 1 else 3)]
    df = spark.createDataFrame(rows, "device_id long, segment long, ts long, event_id long, rsrp_dbm double, lat double, lon double")
    got = {(r["device_id"], r["piece"]): r for r in measure.tracks_to_kml_rows(df, size=3).collect()}
    assert {k: r["n_points"] for k, r in got.items()} == {(1, 0): 3, (1, 1): 3, (1, 2): 1, (2, 0): 3}
    places = lambda r: [p.split(",")[1] for p in r["kml"].split("coordinates>")[1].split("<")[0].split()]
    assert places(got[1, 1]) == ["42.000000", "43.000000", "44.000000", "45.000000"] and places(got[1, 2]) == ["45.000000", "46.000000"]
    assert got[1, 0]["colour"] == "FFFF0000" and "<color>FFFF0000</color>" in got[1, 0]["kml"]
    writers.write_kml(measure.tracks_to_kml_rows(df), str(tmp_path / "kml"))
    assert spark.read.text(str(tmp_path / "kml")).count() == 2
    assert [r["event_id"] for r in measure.order_log(df, "device_id", "ts").collect()] == [0, 1, 2, 3, 4, 5, 6, 0, 1, 2]


def test_rectangles_zones_and_grids(spark):
    from fieldmesh.functions import geo
    from fieldmesh.operators import raster

    corners = lambda c: [(p["x"], p["y"]) for p in spark.range(1).select(c.alias("v")).first()[0]]
    want = [(0.0, 1.0), (0.0, 5.0), (4.0, 5.0), (4.0, 1.0), (0.0, 1.0)]
    n = [F.lit(v) for v in (4.0, 1.0, 0.0, 5.0)]
    assert corners(geo.rect_from_corners(*n)) == corners(geo.rect_from_centre(F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(4.0))) == want
    assert corners(geo.rect_from_range(F.array(F.lit(0.0), F.lit(4.0), F.lit(1.0), F.lit(5.0)))) == want
    assert corners(geo.grow_rect(geo.rect_from_corners(*n), F.lit(1.0)))[0] == (-1.0, 0.0)
    assert spark.range(1).select(geo.assert_zone(F.lit("16 T"), "16 T").alias("z")).first()["z"] == "16 T"
    with pytest.raises(Exception, match="unexpected zone 17 T"):
        spark.range(1).select(geo.assert_zone(F.lit("17 T"), "16 T").alias("z")).collect()
    p = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 3.0), (3, -1.0, 0.0), (4, 0.0, 2.0)], "id long, x double, y double")
    assert [(r["x"], r["y"]) for r in raster.sort_grid(p).collect()] == [(-1.0, 0.0), (0.0, 3.0), (0.0, 2.0)]
    assert terrain.candidate_prefilter(spark.createDataFrame([(19.0,), (20.0,), (250.0,), (251.0,), (None,)], "height_m double")).count() == 2


def test_map_kinds(spark):
    from fieldmesh.operators import maps

    with pytest.raises(ValueError, match="no map of shade"):
        maps.fetch_map(spark.range(1), spark.range(1), spark.range(1), "shade")
    assert [r["x"] for r in maps.threshold_grid(spark, 50.0, 150.0, 5).orderBy("k").collect()] == [50.0, 75.0, 100.0, 125.0, 150.0]
