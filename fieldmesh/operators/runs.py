"""Run bookkeeping: times, histograms, drift, what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (name, singular, plural, seconds), longest first.
UNITS = (("year", 365.25 * 86400), ("month", 30 * 86400), ("week", 7 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / 86400.0


def parse_run_name(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"_HostName_([^_.]+)\.mat$", 1), F.lit(""))


def parse_run_folder(s: Column) -> Column:
    """(preset, carrier_mhz, n_grid, lidar) from a run's folder name; n_grid is null where a run has one size; null for other names."""
    part = lambda k: F.regexp_extract(s, r"Simulation_(.+)_Carrier_([0-9.]+)MHz(?:_NGrid_([0-9]+))?_LiDAR_([^/\\]+)$", k)
    own = F.struct(part(1).alias("preset"), part(2).cast("double").alias("carrier_mhz"), F.nullif(part(3), F.lit("")).cast("int").alias("n_grid"), part(4).alias("lidar"))
    return F.when(part(1) != "", own)


def scale_duration(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    """value and unit, the unit by the largest duration; the largest is one row."""
    top = F.broadcast(df.agg(F.max(seconds).alias("_top")))
    u = F.when(F.col("_top") < 60, F.struct(F.lit("s").alias("u"), F.lit(1.0).alias("d")))
    for name, d in (("min", 3600), ("hour", 86400), ("day", 7 * 86400)):
        u = u.when(F.col("_top") < d, F.struct(F.lit(name).alias("u"), F.lit({"min": 60.0, "hour": 3600.0, "day": 86400.0}[name]).alias("d")))
    u = u.otherwise(F.struct(F.lit("week").alias("u"), F.lit(7 * 86400.0).alias("d")))
    j = df.join(top, F.lit(True)).withColumn("_u", u)
    return j.withColumn("value", F.col(seconds) / F.col("_u.d")).withColumn("unit", F.col("_u.u")).drop("_top", "_u")


def human_duration(seconds: Column) -> Column:
    """The two largest units, such as 'About 1 hour and 5 minutes.'"""
    s = F.round(seconds)
    parts, rest = [], s
    for name, d in UNITS:
        n = F.floor(rest / d).cast("long")
        parts.append(F.when(n > 1, F.concat(n.cast("string"), F.lit(f" {name}s"))).when(n == 1, F.concat(n.cast("string"), F.lit(f" {name}"))))
        # the rest is named once, so the expression grows with the units and does not double with each
        rest = rest % float(d)
    two = F.slice(F.array_compact(F.array(*parts)), 1, 2)
    return F.when(s < 1, "Less than one second.").otherwise(F.concat(F.lit("About "), F.array_join(two, " and "), F.lit(".")))


def time_totals(df: DataFrame, *levels: str) -> DataFrame:
    """Seconds at each level and in all, by rollup."""
    return df.rollup(*levels).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


def exec_metrics(df: DataFrame, level: str) -> DataFrame:
    r = df.rollup(level).agg(F.count("*").alias("n_pixels"), F.countDistinct("map_id").alias("n_maps"), F.sum("seconds").alias("seconds"))
    return r.withColumn("s_per_map", F.col("seconds") / F.col("n_maps")).withColumn("s_per_pixel", F.col("seconds") / F.col("n_pixels"))


def time_pivot(df: DataFrame, row: str, col: str, values: list[str], value: str = "seconds") -> DataFrame:
    """Rows by columns, and an average row of the rows' values."""
    p = df.groupBy(row).pivot(col, values).agg(F.avg(value))
    mean = p.agg(*[F.avg(v).alias(v) for v in values]).withColumn(row, F.lit("average"))
    return p.unionByName(mean)


def log_durations(lines: DataFrame) -> DataFrame:
    """Per tower: seconds from its start line to its finish line, from (line)."""
    ts = F.to_timestamp(F.regexp_extract("line", r"\[([0-9/]+ [0-9:]+)\]", 1), "yyyy/MM/dd HH:mm:ss")
    t = lines.select(F.regexp_extract("line", r"(?i)tower #(\d+)/(\d+)", 1).alias("tower"), ts.alias("ts"), F.col("line").contains("Finished").alias("done")).filter("tower <> ''")
    g = t.groupBy(F.col("tower").cast("long").alias("tower")).agg(F.min(F.when(~F.col("done"), F.col("ts"))).alias("started"), F.max(F.when(F.col("done"), F.col("ts"))).alias("finished"))
    return g.withColumn("seconds", (F.unix_timestamp("finished") - F.unix_timestamp("started")).cast("double"))


def log_totals(durations: DataFrame) -> DataFrame:
    """Summed seconds, first start to last finish, and first start to last start."""
    s = lambda a, b: (F.unix_timestamp(b) - F.unix_timestamp(a)).cast("double")
    return durations.agg(F.sum("seconds").alias("summed_s"), s(F.min("started"), F.max("finished")).alias("span_s"), s(F.min("started"), F.max("started")).alias("start_span_s"))


def histogram(df: DataFrame, value: str, n: int) -> DataFrame:
    """n equal bins from the smallest to the largest, the last closed; counts and shares. bin_centres come along."""
    e = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")))
    k = F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / n)), F.lit(n - 1)).cast("long")
    g = df.join(e, F.lit(True)).filter(F.col(value).isNotNull()).withColumn("bin", F.coalesce(k, F.lit(0)))
    g = g.groupBy("bin", "_lo", "_hi", "_n").agg(F.count("*").alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / n
    return g.select("bin", "n", (F.col("n") / F.col("_n")).alias("share"), (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("centre"))


def config_diff(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, value, side) of what only one of two configurations has."""
    return now.exceptAll(stored).withColumn("side", F.lit("now")).unionByName(stored.exceptAll(now).withColumn("side", F.lit("stored")))


def pending(tasks: DataFrame, done: DataFrame | Column, *keys: str) -> DataFrame:
    """The tasks that are not done. done: a list of keys, or what holds for a done task's own columns, so that no task is moved."""
    if isinstance(done, Column):
        return tasks.filter(~F.coalesce(done, F.lit(False)))
    return tasks.join(done, list(keys), "left_anti")


def scenario_summary(towers: DataFrame, rx: DataFrame, key: str) -> DataFrame:
    t = towers.groupBy(key).agg(F.count("*").alias("n_towers"), F.count_if("effective").alias("n_effective"))
    side = lambda c: F.max(c) - F.min(c)
    r = rx.groupBy(key).agg(F.count("*").alias("n_pixels"), side("x").alias("width_m"), side("y").alias("height_m"))
    r = r.withColumn("area_km2", F.col("width_m") * F.col("height_m") / 1e6)
    return t.join(r, key).withColumn("per_1000_km2", F.col("n_towers") * 1000.0 / F.col("area_km2"))


def scenario_table(scenarios: DataFrame, towers: DataFrame, rx: DataFrame) -> DataFrame:
    """The key parameters of scenarios (poly_id, ring, radius_m, n_side), one row each.

    area_km2; n_tower_in_area and their density_per_1000_km2; sim_area_km2, the area grown by the radius (for convex boundaries, else
    null); n_tower, those inside the area or within the radius of its boundary; side_km, the box' longer side; n_side pixels along it
    and delta_km between them; n_user receivers in the area. towers: (tower_id, x, y), rx: (rx_id, x, y).
    """
    from .spatial import edges_of, near_boundary, points_in_polygon, polygon_area_km2

    n = F.size("ring") - 1
    corner = lambda i: F.element_at("ring", (i % n + 1).cast("int"))
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda i: turn(corner(i), corner(i + 1), corner(i + 2)))
    side = lambda c: F.array_max(F.transform("ring", lambda q: q[c])) - F.array_min(F.transform("ring", lambda q: q[c]))
    convex = F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)
    s = scenarios.select("poly_id", "radius_m", "n_side", convex.alias("_convex"), (F.greatest(side("x"), side("y")) / 1000.0).alias("side_km"))
    e = edges_of(scenarios)
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    s = s.join(polygon_area_km2(scenarios), "poly_id").join(e.groupBy("poly_id").agg(F.sum(length).alias("_around_m")), "poly_id")
    inside = points_in_polygon(towers, scenarios, "tower_id")
    widest = scenarios.agg(F.max("radius_m")).first()[0] or 1.0
    near = near_boundary(towers, scenarios, "tower_id", widest).join(scenarios.select("poly_id", "radius_m"), "poly_id").filter("boundary_m <= radius_m")
    count = lambda df, name: df.groupBy("poly_id").agg(F.count("*").alias(name))
    effective = inside.unionByName(near.select("tower_id", "poly_id")).distinct()
    for df, name in ((inside, "n_tower_in_area"), (effective, "n_tower"), (points_in_polygon(rx, scenarios, "rx_id"), "n_user")):
        s = s.join(count(df, name), "poly_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    r = F.col("radius_m") / 1000.0
    grown = F.when(F.col("_convex"), F.col("area_km2") + F.col("_around_m") / 1000.0 * r + F.pi() * r * r)
    return s.select(
        "poly_id", "area_km2", "n_tower_in_area", (F.col("n_tower_in_area") * 1000.0 / F.col("area_km2")).alias("density_per_1000_km2"), grown.alias("sim_area_km2"),
        "n_tower", "side_km", "n_side", (F.col("side_km") / F.col("n_side")).alias("delta_km"), "n_user",
    )


#: Rows of a parameter list that is broadcast, at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """A list of parameters, counted before it is broadcast; more than FEW are an error."""
    n = df.limit(FEW + 1).count()
    if n > FEW:
        raise ValueError(f"more than {FEW} rows of parameters")
    return F.broadcast(df)


def sweep(*frames: DataFrame) -> DataFrame:
    """Every combination of the parameters' few values; the first list may be of any length."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(few(f))
    return out


def join_point_results(points: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("gid", "height_m")) -> DataFrame:
    """Results back at their source points, group by group; a point or result without its partner is an error."""
    p, r = points.withColumn("_p", F.lit(1)), results.withColumn("_r", F.lit(1))
    j = p.join(r, list(keys), "full_outer")
    ok = F.col("_p").isNotNull() & F.col("_r").isNotNull()
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("points and results differ at "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return j.filter(checked).drop("_p", "_r")


def select_counties(counties: DataFrame, state: str, names: list[str] | None = None) -> DataFrame:
    """Areas (statefp, name) of a state, all or those named."""
    out = counties.filter(F.col("statefp") == state)
    return out if names is None else out.filter(F.col("name").isin(names))
