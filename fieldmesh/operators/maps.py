"""Maps: the best server over towers, coverage ratios, empirical distributions and gains.

A map is long: (rx_height_m, rx_id, loss_db); null is out of coverage. NaN is never let in.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmesh.functions.geo import from_utm

from .ranges import carried, running_sum, with_next
from .runs import few
from .scratch import cut_lineage
from .spatial import range_join, sized


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def combine_towers(links: DataFrame, keys: tuple[str, ...] = ("rx_height_m", "rx_id"), values: tuple[str, ...] = ("loss_db",)) -> DataFrame:
    """The smallest of each value over towers; a partial minimum comes before the shuffle."""
    return links.groupBy(*keys).agg(*[F.min(no_nan(F.col(v))).alias(v) for v in values])


def nearest_server(rx: DataFrame, towers: DataFrame, radius: float, heights: tuple[float, ...]) -> DataFrame:
    """(rx_height_m, rx_id, dist_m): for each height, the least straight distance to a tower (x, y, height_m) within a planar radius.

    A loss that grows with the distance is least there. Equal sites count once. A row that has every height's distance within the
    radius searched so far is done, as a tower further off in the plane is further off in space; the rest look four times as far,
    up to the whole radius. The first radius goes with the sites' density, so a row meets few of them. No tower: no row.
    """
    sites = cut_lineage(towers.select("x", "y", "height_m").dropna().distinct(), "sites")
    n, w, h = sites.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    r = min(max(2.0 * math.sqrt((w or 0.0) * (h or 0.0) / max(n, 1)), radius / 64.0), radius)
    left, out = rx.select("rx_id", "x", "y").dropna(subset=["x", "y"]), None
    names = [f"_d{i}" for i in range(len(heights))]
    while True:
        pairs = range_join(left, sites, r)
        square = [F.col("dist_m") * F.col("dist_m") + (F.col("b_height_m") - v) * (F.col("b_height_m") - v) for v in heights]
        hit = pairs.groupBy("rx_id").agg(*[F.min(q).alias(c) for c, q in zip(names, square, strict=True)])
        last = r >= radius
        hit = cut_lineage(hit if last else hit.filter(F.greatest(*names, F.lit(0.0)) <= r * r), "server")
        out = hit if out is None else out.unionByName(hit)
        if not last:
            left = left.alias("a").join(hit.select("rx_id").alias("h"), F.col("a.rx_id").eqNullSafe(F.col("h.rx_id")), "left_anti")
        if last or not left.limit(1).count():
            break
        r = min(r * 4.0, radius)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("rx_height_m"), F.sqrt(c).alias("dist_m")) for v, c in zip(heights, names, strict=True)]))
    return out.select("rx_id", each.alias("q")).select("q.rx_height_m", "rx_id", "q.dist_m")


def clip_to_null(v: Column, lo: float, hi: float) -> Column:
    return F.when(v.between(lo, hi), v)


def coverage_ratio(m: DataFrame, max_db: float | None = None) -> DataFrame:
    ok = F.col("loss_db").isNotNull() if max_db is None else F.col("loss_db") <= max_db
    return m.groupBy("rx_height_m").agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("n_covered")).withColumn("ratio", F.col("n_covered") / F.col("n"))


def coverage_sweep(m: DataFrame, lo: int, hi: int) -> DataFrame:
    """Ratio at each whole threshold lo..hi: a histogram of ceilings, then running sums."""
    bin_ = F.greatest(F.ceil("loss_db"), F.lit(lo)).cast("long")
    h = m.groupBy("rx_height_m").agg(F.count("*").alias("n")).withColumn("threshold", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))))
    c = m.filter(F.col("loss_db") <= hi).groupBy("rx_height_m", bin_.alias("threshold")).agg(F.count("*").alias("c"))
    run = W.partitionBy("rx_height_m").orderBy("threshold").rowsBetween(W.unboundedPreceding, 0)
    j = h.join(c, ["rx_height_m", "threshold"], "left").withColumn("n_covered", F.sum(F.coalesce("c", F.lit(0))).over(run))
    return j.select("rx_height_m", "threshold", (F.col("n_covered") / F.col("n")).alias("ratio"))


def ecdf(m: DataFrame, value: str = "loss_db", key: str = "rx_height_m") -> DataFrame:
    """(key, v, p) over distinct values, with the extra point (smallest, 0); nulls stay in the denominator.

    Values are counted, dealt to ranges of (key, value) and summed range by range: no task holds a key's values.
    """
    n = m.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("first"))
    c = m.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = running_sum(c, [F.col(key), F.col("v")], F.col("c"), "upto", [key])
    p = upto.join(n, key).select(key, "v", (F.col("upto") / F.col("n")).alias("p"))
    return p.unionByName(n.filter(F.col("first").isNotNull()).select(key, F.col("first").alias("v"), F.lit(0.0).alias("p")))


def _segments(cdf: DataFrame, key: str) -> DataFrame:
    """Neighbouring points of the distribution."""
    return with_next(cdf, [F.col(key), F.col("p"), F.col("v")], {"v1": "v", "p1": "p"}, [key])


def _met(at: DataFrame, keys: DataFrame, seg: DataFrame, key: str, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Every place (k, x) of every key with the segment [lo, hi) that holds it, if any; a last point holds itself only.

    Segments and places meet in buckets of `width`: an equi-join, in which a segment stands once in each bucket it crosses.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    s = seg.withColumn("_b", F.explode(F.sequence(cell(lo), F.coalesce(cell(hi), cell(lo)))))
    p = keys.crossJoin(few(at)).withColumn("_b", cell(x))  # the result's rows: places times keys
    holds = (F.col(x) >= F.col(lo)) & ((F.col(x) < F.col(hi)) | (F.col(hi).isNull() & (F.col(x) == F.col(lo))))
    return p.alias("p").join(s.alias("s"), (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._b") == F.col("s._b")) & holds, "left").select("p.*", "v", "p", "v1", "p1").drop("_b")


def ecdf_at(cdf: DataFrame, at: DataFrame, key: str = "rx_height_m", width: float = 0.125) -> DataFrame:
    """The distribution at values (k, x), linear between points; null outside its range. width: of buckets, in the value's unit."""
    s = _segments(cdf.groupBy(key, "v").agg(F.max("p").alias("p")), key)
    j = _met(at, cdf.select(key).distinct(), s, key, "x", "v", "v1", width)
    p = F.when(F.col("v1").isNull(), F.col("p")).otherwise(F.col("p") + (F.col("p1") - F.col("p")) * (F.col("x") - F.col("v")) / (F.col("v1") - F.col("v")))
    return j.select(key, "k", *[c for c in at.columns if c != "k"], p.alias("p"))


def ecdf_inverse(cdf: DataFrame, at: DataFrame, key: str = "rx_height_m", width: float = 1 / 1024) -> DataFrame:
    """The value at shares (k, q), linear between points; null beyond the covered share."""
    j = _met(at, cdf.select(key).distinct(), _segments(cdf, key), key, "q", "p", "p1", width)
    v = F.when(F.col("p1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (F.col("q") - F.col("p")) / (F.col("p1") - F.col("p")))
    return j.select(key, "k", *[c for c in at.columns if c != "k"], v.alias("v"))


def coverage_ratio_gain(m: DataFrame, n: int = 10_000, far: float = 1e6) -> DataFrame:
    """Each height's distribution minus the first height's, in percent, on n shared thresholds.

    Below a map's values the share is 0; past its last finite one it grows toward 1 at `far` dB.
    """
    cdf = ecdf(m)
    ends = cdf.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    at = ends.select("lo", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("k", (F.col("lo") + F.col("k") * F.col("step")).alias("x"))
    edge = cdf.groupBy("rx_height_m").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("p").alias("top"))
    got = ecdf_at(cdf, at).join(edge, "rx_height_m")
    late = F.col("top") + (F.lit(1.0) - F.col("top")) * (F.col("x") - F.col("hi")) / (F.lit(far) - F.col("hi"))
    p = F.when(F.col("x") < F.col("lo"), 0.0).when(F.col("x") > F.col("hi"), late).otherwise(F.coalesce("p", "top"))
    first = F.first("share").over(W.partitionBy("k").orderBy("rx_height_m"))
    return got.withColumn("share", p).withColumn("gain_pct", (F.col("share") - first) * 100.0).select("rx_height_m", "k", "x", "share", "gain_pct")


def relay_gain(m: DataFrame, n: int = 1000) -> DataFrame:
    """The first height's loss at each covered share minus each height's; the first invalid entry is 0, the rest null."""
    at = threshold_grid(m.sparkSession, 0.0, 1.0, n).select(F.col("k").cast("int").alias("k"), (F.col("k") / float(n - 1)).alias("q"))
    inv = ecdf_inverse(ecdf(m), at)
    gain = F.first("v").over(W.partitionBy("k").orderBy("rx_height_m")) - F.col("v")
    inv = inv.withColumn("g", gain)
    bad = F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).over(W.partitionBy("rx_height_m").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return inv.withColumn("bad", bad).select("rx_height_m", "k", "q", F.when(F.col("bad") == 0, F.col("g")).when((F.col("bad") == 1) & F.col("g").isNull(), 0.0).alias("gain_db"))


def los_gain(ratios: DataFrame) -> DataFrame:
    """Few rows: one for each height."""
    first = F.first("ratio").over(W.partitionBy(F.lit(1)).orderBy("rx_height_m"))
    return ratios.withColumn("gain", F.col("ratio") - first)


def improvement_map(m: DataFrame) -> DataFrame:
    """Per pixel, the lowest height's loss minus each height's."""
    first = F.first("loss_db").over(W.partitionBy("rx_id").orderBy("rx_height_m"))
    return m.withColumn("improvement_db", first - F.col("loss_db"))


def extend_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each value, or the last known one before it in its key's order; carried from range to range."""
    return carried(df, [F.col(key), F.col(order)], value, [key])


def run_ranges(m: DataFrame, value: str = "loss_db", key: str = "rx_height_m") -> DataFrame:
    return m.groupBy(key).agg(F.min(no_nan(F.col(value))).alias("lowest"), F.max(no_nan(F.col(value))).alias("highest"))


def best_stations(m: DataFrame, pct: float) -> DataFrame:
    """The best pct percent of each height: loss at or below the interpolated share."""
    at = m.sparkSession.range(1).select(F.col("id").alias("k"), F.lit(pct / 100.0).alias("q"))
    t = ecdf_inverse(ecdf(m), at).select("rx_height_m", F.col("v").alias("limit_db"))
    return m.join(F.broadcast(t), "rx_height_m").filter(F.col("loss_db") <= F.col("limit_db"))


def extra_towers(m: DataFrame, area_km2: float, max_db: float, wavelength: float) -> DataFrame:
    """Towers that would fill the uncovered area, each with its free-space circle."""
    r_km = wavelength / (4 * math.pi) * 10 ** (max_db / 20) / 1000.0
    c = coverage_ratio(m, max_db)
    return c.withColumn("extra_towers", (F.lit(1.0) - F.col("ratio")) * area_km2 / (math.pi * r_km**2)).withColumn("extra_rounded", F.ceil("extra_towers").cast("long"))


def extra_towers_by_table(m: DataFrame, table: DataFrame, areas: DataFrame, max_db: float) -> DataFrame:
    """The same with the radius at which a (dist_km, loss_db) table reaches the largest loss, linear between its rows.

    areas: (rx_height_m, area_km2, n_existing). The radius is null where the table does not reach that loss.
    """
    w = W.orderBy("loss_db", "dist_km")  # a loss curve: few rows
    seg = table.select("dist_km", "loss_db", F.lead("dist_km").over(w).alias("d1"), F.lead("loss_db").over(w).alias("l1"))
    hold = seg.filter((F.col("loss_db") <= max_db) & ((F.col("l1") > max_db) | (F.col("l1").isNull() & (F.col("loss_db") == max_db))))
    r = hold.select((F.col("dist_km") + F.coalesce((F.col("d1") - F.col("dist_km")) * (F.lit(max_db) - F.col("loss_db")) / (F.col("l1") - F.col("loss_db")), F.lit(0.0))).alias("radius_km")).agg(F.max("radius_km").alias("radius_km"))
    c = coverage_ratio(m, max_db).join(areas, "rx_height_m").crossJoin(F.broadcast(r))
    c = c.withColumn("extra_towers", (F.lit(1.0) - F.col("ratio")) * F.col("area_km2") / (F.col("radius_km") * F.col("radius_km") * math.pi))
    return c.withColumn("extra_rounded", F.ceil("extra_towers").cast("long")).withColumn("n_all", F.col("n_existing") + F.col("extra_rounded"))


def _less(a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


#: The kinds of maps, and their values from the columns of link results.
MAP_KINDS = {
    "blockage": lambda: F.col("blockage_db"),
    "coverage": lambda: F.col("coverage_db"),
    "coverage_itm": lambda: F.col("coverage_itm_db"),
    "blockage_dist": lambda: F.col("blockage_dist_m"),
    "blockage_by_terrain_dist": lambda: F.col("terrain_dist_m"),
    "blockage_by_veg_dist": lambda: _less("blockage_dist_m", "terrain_dist_m"),
    "path_loss_with_veg": lambda: F.col("loss_with_veg_db"),
}


def fetch_map(results: DataFrame, rx: DataFrame, towers: DataFrame, kind: str, loc: str = "utm", zone: int = 16, north: bool = True) -> DataFrame:
    """(tower_id, rx_id, rx_height_m, value, x, y, tx_x, tx_y) of a kind of map; by gps (lon, lat) places instead of (x, y).

    rx has rx_id, x, y and, for gps, lat, lon; towers' places are turned from the zone's metres. Unknown kinds are an error.
    """
    return fetch_maps(results, rx, towers, (kind,), loc, zone, north).drop("kind")


def fetch_maps(results: DataFrame, rx: DataFrame, towers: DataFrame, kinds: Iterable[str], loc: str = "utm", zone: int = 16, north: bool = True) -> DataFrame:
    """The same for several kinds, with kind: the results meet their places once, whatever the number of kinds.

    Results are not sorted, and not moved where they are dealt by rx_id (range_join's by) and towers are few.
    """
    kinds = list(kinds)
    for kind in kinds:
        if kind not in MAP_KINDS or loc not in ("utm", "gps"):
            raise ValueError(f"no map of {kind} by {loc}")
    one = [F.struct(F.lit(k).alias("kind"), MAP_KINDS[k]().alias("value")) for k in kinds]
    own = results.select("tower_id", "rx_id", "rx_height_m", F.array(*one).alias("_m"))
    if loc == "utm":
        pixel, mast = rx.select("rx_id", "x", "y"), towers.select("tower_id", F.col("x").alias("tx_x"), F.col("y").alias("tx_y"))
    else:
        lat, lon = from_utm(F.col("x"), F.col("y"), F.lit(float(zone)), F.lit(north))
        pixel, mast = rx.select("rx_id", "lon", "lat"), towers.select("tower_id", lon.alias("tx_lon"), lat.alias("tx_lat"))
    j = own.join(sized(mast, towers.count(), 64), "tower_id").join(pixel.hint("shuffle_hash"), "rx_id").withColumn("_m", F.explode("_m"))
    return j.select("tower_id", "rx_id", "rx_height_m", F.col("_m.value").alias("value"), *pixel.columns[1:], *mast.columns[1:], F.col("_m.kind").alias("kind"))


def threshold_grid(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(k, x): n places from lo to hi, both included, equally far apart."""
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * step + lo).alias("x"))
