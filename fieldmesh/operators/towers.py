"""Transmitter tables: merging sources, density, zones, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmesh.functions import radio

from .ranges import ranked
from .spatial import nearest, points_in_polygon, range_join

DEFAULT_HEIGHT_M = 50.0


def with_default_height(towers: DataFrame) -> DataFrame:
    return towers.withColumn("height_m", F.coalesce(F.nanvl("height_m", F.lit(None).cast("double")), F.lit(DEFAULT_HEIGHT_M)))


def number_sites(df: DataFrame, *order: str) -> DataFrame:
    """Site ids from 1 on by rank, nulls last: ranges are written once, ranked inside, and offset by the rows before them.

    Rows with equal keys are numbered in the order of their hashes, so extra columns never make ids meet.
    """
    return ranked(df, [F.col(c).asc_nulls_last() for c in order], "site")


def merge_towers(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """All new towers, and the old ones that are not the nearest of a new tower closer than the threshold; numbered by place."""
    hit = _nearest_old(new, old, threshold)
    gone = hit.filter(F.col("dist_m") < threshold).select(F.col("old_id").alias("tower_id")).distinct()
    kept = old.join(gone, "tower_id", "left_anti").select("x", "y", F.lit(None).cast("double").alias("height_m"))
    return number_sites(new.select("x", "y", "height_m").unionByName(kept), "y", "x", "height_m")


def _nearest_old(new: DataFrame, old: DataFrame, start: float) -> DataFrame:
    b = old.select(F.col("tower_id").alias("old_id"), "x", "y")
    return nearest(new, b, "tower_id", "old_id", start).select("tower_id", F.col("nearest_old_id").alias("old_id"), "dist_m")


def merge_stats(new: DataFrame, old: DataFrame, thresholds: tuple[float, ...], area: DataFrame | None = None) -> DataFrame:
    """For each threshold: new towers with a nearest old one closer, distinct old towers that go, and the new ones' share.

    With an area (polygons) also the same of the new towers inside or on it: n_new_in_area and pct_in_area.
    """
    near = _nearest_old(new, old, max(thresholds))
    if area is not None:
        hit = points_in_polygon(new, area, "tower_id").select("tower_id").distinct().withColumn("_in", F.lit(True))
        near = near.join(hit, "tower_id", "left")
    inside = F.coalesce(F.col("_in"), F.lit(False)) if area is not None else F.lit(False)
    t = near.withColumn("_inside", inside).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = F.coalesce(F.col("dist_m") < F.col("threshold"), F.lit(False))
    g = t.groupBy("threshold").agg(
        F.count_if(hit).alias("n_new"), F.countDistinct(F.when(hit, F.col("old_id"))).alias("n_old"), F.count("*").alias("_all"),
        F.count_if(hit & F.col("_inside")).alias("n_new_in_area"), F.count_if(F.col("_inside")).alias("_all_in"),
    )
    g = g.withColumn("pct", F.col("n_new") * 100.0 / F.col("_all"))
    more = ["n_new_in_area", F.when(F.col("_all_in") > 0, F.col("n_new_in_area") * 100.0 / F.col("_all_in")).alias("pct_in_area")]
    return g.select("threshold", "n_new", "n_old", "pct", *(more if area is not None else []))


def union_sources(**sources: DataFrame) -> DataFrame:
    out = None
    for label, df in sources.items():
        part = df.withColumn("source", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def tower_density(grid: DataFrame, towers: DataFrame, radius: float = 50_000.0) -> DataFrame:
    """Towers within the radius of each grid point, and per 1000 km2."""
    n = range_join(grid.select("rx_id", "x", "y"), towers.select("tower_id", "x", "y"), radius).groupBy("rx_id").agg(F.count("*").alias("n"))
    out = grid.select("rx_id").join(n, "rx_id", "left").withColumn("n_towers", F.coalesce("n", F.lit(0)))
    return out.select("rx_id", "n_towers", (F.col("n_towers") * 1000.0 / (F.pi() * (radius / 1000.0) ** 2)).alias("per_1000_km2"))


def short_link_ratio(links: DataFrame, short: float = 1000.0) -> DataFrame:
    return links.agg(F.count_if(F.col("dist_m") < short).alias("n_short"), F.count("*").alias("n_links")).withColumn("ratio", F.col("n_short") / F.col("n_links"))


def optimistic_fspl(rx: DataFrame, towers: DataFrame, mhz: float, start: float) -> DataFrame:
    return nearest(rx, towers, "rx_id", "tower_id", start).withColumn("fspl_db", radio.fspl_db(F.col("dist_m"), radio.wavelength_m(F.lit(mhz))))


def antenna_radius(towers: DataFrame, rx_height_m: float, strategy: str) -> DataFrame:
    """One row, the radio horizon of the lowest or highest antennas (tower heights null: the default)."""
    pick = {"lowest": F.min, "highest": F.max}[strategy]
    return with_default_height(towers).agg(pick("height_m").alias("height_m")).withColumn("radius_m", radio.horizon_radius_m(F.col("height_m"), F.lit(rx_height_m)))


def gateways_to_towers(df: DataFrame) -> DataFrame:
    t = df.select(F.col("latitude").alias("lat"), F.col("longitude").alias("long"), F.col("altitude_above_ground_meters").alias("height_m"))
    return number_sites(t, "lat", "long", "height_m")
