"""Scans with stated schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_TELEPHONY = "telephony:struct<connection_type:string>"
_TRANSFER = f"struct<bytes_transferred:double,duration:double,environment:struct<beginning:struct<{_TELEPHONY}>,end:struct<{_TELEPHONY},location:struct<lat:double,lon:double>>>>"
#: The two vendors' shapes; their legs differ by case only, so each has a schema of its own.
SPEEDTEST_A = f"operating_system_version string, carrier_name string, tests struct<testId:string,download:{_TRANSFER},upload:{_TRANSFER}>"
_RESULT = "referenceNumber:string,testResult:double,latitude:double,longitude:double,isWiFi:boolean"
SPEEDTEST_B = f"device_environment struct<operating_system_version:string,carrier_name:string>, tests struct<Download:struct<{_RESULT}>,Upload:struct<{_RESULT}>>"


def read_towers(spark: SparkSession, path: str) -> DataFrame:
    """site, lat, long and an optional height; the site column is dropped."""
    cols = spark.read.csv(path, header=True).columns
    schema = "site long, lat double, long double" + (", height_m double" if len(cols) > 3 else "")
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    return df.select("lat", "long", F.col("height_m") if len(cols) > 3 else F.lit(None).cast("double").alias("height_m"))


def read_rx_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gid long, lon double, lat double, height_m double").csv(path, header=True)


def read_rx_list(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon) of a list of receivers with the columns RXLatitudes and RXLongitudes, wherever they stand."""
    return spark.read.csv(path, header=True).select(F.col("RXLatitudes").cast("double").alias("lat"), F.col("RXLongitudes").cast("double").alias("lon"))


def read_stations(spark: SparkSession, path: str, check_ids: bool = False) -> DataFrame:
    df = spark.read.schema("id int, name string, latitude double, longitude double").csv(path, header=True)
    if check_ids:
        r = df.agg(F.max("id"), F.count("*"), F.countDistinct("id")).first()
        if not r[0] == r[1] == r[2]:
            raise ValueError("station ids are not 1..n")
    return df


def read_rsrp(spark: SparkSession, path: str) -> DataFrame:
    """Two generations of columns, which a folder may mix: with lte_primary_rsrp, or with rsrp of rows marked primary.

    Files are told apart by their header; one with neither generation's columns is an error.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # a header is the first line of a file's first block: one row for each file
    heads = lines.filter("start = 0").groupBy("file").agg(F.first("value").alias("head")).collect()
    by_head: dict[str, list[str]] = {}
    for r in heads:
        by_head.setdefault(r["head"], []).append(r["file"])
    frames = [_rsrp_generation(spark.read.csv(sorted(files), header=True)) for files in by_head.values()]
    return reduce(DataFrame.unionByName, frames)


def _rsrp_generation(raw: DataFrame) -> DataFrame:
    common = [F.col("device_id") if "device_id" in raw.columns else F.lit(None).cast("string").alias("device_id"), "timestamp", "carrier", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")]
    if "lte_primary_rsrp" in raw.columns:
        return raw.select(*common, F.col("lte_primary_rsrp").cast("double").alias("rsrp_dbm"))
    if "primary/other*" in raw.columns and "rsrp" in raw.columns:
        return raw.filter(F.lower(F.col("`primary/other*`")) == "primary").select(*common, F.col("rsrp").cast("double").alias("rsrp_dbm"))
    raise ValueError("neither generation of signal log columns")


def read_speedtests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tests in one shape, files of neither shape). Folders named __MACOSX are skipped; a missing id is the file's name."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))
    raw = raw.filter(~F.col("file").contains("__MACOSX"))
    raw = raw.select("file", "file_name", F.from_json("value", SPEEDTEST_A).alias("a"), F.from_json("value", SPEEDTEST_B).alias("b"))
    raw = raw.withColumn("shape", F.when(F.col("a.tests.download").isNotNull(), "A").when(F.col("b.tests.Download").isNotNull(), "B"))
    base = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1)
    either = lambda a, b: F.when(F.col("shape") == "A", a).otherwise(b)
    leg = lambda s: either(F.col(f"a.tests.{s}.bytes_transferred") * 8.0 / F.col(f"a.tests.{s}.duration"), F.col(f"b.tests.{s}.testResult")) * 1e6
    at = lambda s, c: either(F.col(f"a.tests.{s}.environment.end.location.{c[:3]}"), F.col(f"b.tests.{s}.{c}"))
    kind = lambda s, e: F.col(f"a.tests.{s}.environment.{e}.telephony.connection_type")
    on_cell = reduce(Column.__and__, [kind(s, e) == "cell" for s in ("download", "upload") for e in ("beginning", "end")])
    cell = either(on_cell, ~F.col("b.tests.download.isWiFi") & ~F.col("b.tests.upload.isWiFi"))
    good = raw.filter("shape IS NOT NULL").select(
        F.coalesce("a.tests.testId", "b.tests.download.referenceNumber", base).alias("test_id"), "shape",
        F.coalesce("a.operating_system_version", "b.device_environment.operating_system_version").alias("os"),
        F.coalesce("a.carrier_name", "b.device_environment.carrier_name").alias("carrier"),
        leg("download").alias("down_bps"), leg("upload").alias("up_bps"),
        at("download", "latitude").alias("down_lat"), at("download", "longitude").alias("down_lon"),
        at("upload", "latitude").alias("up_lat"), at("upload", "longitude").alias("up_lon"),
        F.coalesce(cell, F.lit(False)).alias("cellular"),
    )
    return good, raw.filter("shape IS NULL").select("file")


#: A decoded raster cell.
RASTER = "tile string, row long, col long, x double, y double, z double, ele double"


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Decoded cells; in a folder parted by tile (tile=...), a filter on the tile prunes the others' files."""
    return spark.read.schema(RASTER).parquet(path)


def raster_tiles(raster: DataFrame) -> DataFrame:
    """(tile_no, tile, n_cells) by name. Tiles are few beside their cells; numbering them sorts only their names."""
    t = raster.groupBy("tile").agg(F.count("*").alias("n_cells"))
    return t.select(F.row_number().over(W.orderBy("tile")).cast("long").alias("tile_no"), "tile", "n_cells")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a GeoJSON feature collection: (poly_id, ring); items with holes are an error."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).filter("f.geometry.type = 'Polygon'")
    rings = F.col("f.geometry.coordinates")
    one = F.when(F.size(rings) == 1, rings[0]).otherwise(F.raise_error(F.lit("a boundary has holes")).cast("array<array<double>>"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = F.transform(F.filter(one, lambda p: p[0].isNotNull() & ~F.isnan(p[0])), point)
    return f.select(F.col("f.id").alias("poly_id"), ring.alias("ring"))


def one_zone(polygons: DataFrame) -> DataFrame:
    """Polygons of longitudes and latitudes whose corners share one zone of six degrees; a polygon across zones is an error."""
    zones = F.array_distinct(F.transform("ring", lambda p: F.floor((p["x"] + 180.0) / 6.0)))
    checked = F.when(F.size(zones) <= 1, True).otherwise(F.raise_error(F.concat(F.lit("a boundary crosses zones: "), F.col("poly_id").cast("string"))).cast("boolean"))
    return polygons.filter(checked)
