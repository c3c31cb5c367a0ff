"""Ordered operations over ranges against plain ones, and their plans."""

import random

from pyspark.sql import functions as F

from fieldmesh.operators import maps, ranges, towers


def test_site_numbers_are_unique_and_in_order(spark):
    n = 2_000_000
    df = spark.range(n).select((F.col("id") * 7919 % 1009).cast("double").alias("y"), F.when(F.col("id") % 3 > 0, F.col("id") * 31 % 5003).alias("x"), F.concat(F.lit("extra"), F.col("id")).alias("name"))
    out = towers.number_sites(df, "y", "x")
    slim = out.select("y", "x", "site")  # a column that is no sort key goes before the rows are looked at
    got = slim.agg(F.count("*"), F.countDistinct("site"), F.min("site"), F.max("site")).first()
    assert tuple(got) == (n, n, 1, n)
    assert out.join(df, "name").count() == n and out.agg(F.countDistinct("site")).first()[0] == n
    # the order: every site's key is at least the key before it
    after = out.select((F.col("site") + 1).alias("site"), F.struct("y", F.col("x").isNull(), F.coalesce("x", F.lit(0))).alias("before"))
    bad = out.join(after, "site").filter(F.struct("y", F.col("x").isNull(), F.coalesce("x", F.lit(0))) < F.col("before"))
    assert bad.count() == 0


def test_equal_keys_spread_over_ranges(spark):
    df = spark.range(200_000).select(F.lit(1.0).alias("y"), "id").repartition(8)
    part = ranges.frozen(df, [F.col("y")])
    assert part.groupBy(ranges.PART).count().count() > 1
    out = towers.number_sites(df, "y")
    assert out.agg(F.countDistinct("site"), F.max("site")).first() == (200_000, 200_000)


def _rows(seed):
    rng = random.Random(seed)
    return [(rng.choice([None, "a", "b", "c"]), k, rng.choice([None, rng.random()])) for k in range(400)]


def test_running_sums_carries_and_neighbours(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(6)
    keys = [F.col("g"), F.col("k")]
    total, last, want_next = {}, {}, {}
    sums, carries = {}, {}
    for g, k, v in rows:
        total[g] = total.get(g, 0) + k
        sums[g, k] = total[g]
        last[g] = v if v is not None else last.get(g)
        carries[g, k] = last[g]
    for (g, k, _), (h, m, v) in ((a, b) for i, a in enumerate(rows) for b in [next((r for r in rows[i + 1 :] if r[0] == a[0]), (None, None, None))]):
        want_next[g, k] = (m, v)
        assert h == g or m is None
    assert {(r["g"], r["k"]): r["s"] for r in ranges.running_sum(df, keys, F.col("k"), "s", ["g"]).collect()} == sums
    assert {(r["g"], r["k"]): r["v"] for r in ranges.carried(df, keys, "v", ["g"]).collect()} == carries
    got = ranges.with_next(df, keys, {"k1": "k", "v1": "v"}, ["g"])
    assert {(r["g"], r["k"]): (r["k1"], r["v1"]) for r in got.collect()} == want_next
    assert ranges.ranked(df.limit(0), keys, "r").count() == 0


def _windows(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.splitlines() if "Window [" in line]


def test_no_window_holds_a_whole_height(spark):
    m = spark.range(1000).select((F.col("id") % 4).cast("double").alias("rx_height_m"), F.col("id").alias("rx_id"), (F.col("id") * 7 % 90 + 60.5).alias("loss_db"))
    cdf = maps.ecdf(m)
    for out in (cdf, maps._segments(cdf, "rx_height_m"), maps.extend_last(m, "rx_height_m", "rx_id", "loss_db")):
        windows = _windows(out)
        # over rows: by range and height; over ranges: aggregated rows only
        assert windows and all(ranges.PART in w for w in windows)
