"""Coverage tables derived from the given ones, in Spark and as SQL with the same integer expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres between raster cells, and the carrier of the examples.
RES, MHZ = 2500.0, 1900.0
RADIUS = 34_200.0
#: A closed, non-convex ring in tower coordinates, and one with a vertex on receiver points.
RINGS = {
    1: [(9050.0, 8050.0), (12050.0, 70050.0), (40050.0, 91050.0), (55050.0, 45050.0), (70050.0, 88050.0), (93050.0, 60050.0), (80050.0, 12050.0), (50050.0, 30050.0), (9050.0, 8050.0)],
    2: [(20050.0, 20050.0), (20050.0, 60050.0), (60050.0, 60050.0), (60050.0, 20050.0), (20050.0, 20050.0)],
}
SQL: dict[str, str] = {
    "towers": "SELECT s_suppkey AS tower_id, ((s_suppkey * 7919) % 1000) * 100e0 AS x, ((s_suppkey * 104729) % 1000) * 100e0 AS y, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 20e0 + s_suppkey % 80 END AS height_m FROM supplier",
    "towers_new": "SELECT n_nationkey * 3 + k AS tower_id, ((n_nationkey * 3571) % 1000) * 100e0 + 37.5e0 * k AS x, ((n_nationkey * 2741) % 1000) * 100e0 AS y, 30e0 + k AS height_m FROM nation, (SELECT unnest([0, 1, 2]) AS k)",
    "rx": "SELECT c_custkey AS rx_id, ((c_custkey * 6151) % 1000) * 100e0 + 50 + 25 * (c_custkey // 1000) AS x, ((c_custkey * 3079) % 1000) * 100e0 + 50 AS y FROM customer",
    "raster": "SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, (p_partkey % 50) * 2500e0 AS x, (p_partkey // 50) * 2500e0 AS y, p_retailprice % 97 AS z, p_size::DOUBLE AS ele FROM part",
    "rsrp": "SELECT event_id, user_id AS device_id, ts, event_type AS carrier, -60e0 - ((event_id * 37) % 60) AS rsrp_dbm, 40 + (event_id % 100) / 1000e0 AS lat, -105 + (event_id % 77) / 1000e0 AS lon FROM events",
    "edges": " UNION ALL ".join(f"SELECT {k} AS poly_id, {i} AS seq, {a[0]!r}::DOUBLE AS x1, {a[1]!r}::DOUBLE AS y1, {b[0]!r}::DOUBLE AS x2, {b[1]!r}::DOUBLE AS y2" for k, r in RINGS.items() for i, (a, b) in enumerate(zip(r, r[1:], strict=False))),
    "links": "SELECT r.rx_id, t.tower_id, r.x, r.y, t.x AS tx_x, t.y AS tx_y, t.height_m AS tx_height_m, sqrt((r.x - t.x) * (r.x - t.x) + (r.y - t.y) * (r.y - t.y)) AS dist_m FROM rx r JOIN towers t ON sqrt((r.x - t.x) * (r.x - t.x) + (r.y - t.y) * (r.y - t.y)) <= 34200",
    "heights": "SELECT unnest([1.5e0, 3e0, 5e0, 7.5e0, 10e0, 50e0, 100e0, 125e0]) AS rx_height_m",
    "lossy": "SELECT rx_height_m, rx_id, tower_id, greatest(0, 20 * log10(4 * pi() * sqrt(dist_m * dist_m + (coalesce(tx_height_m, 50) - rx_height_m) * (coalesce(tx_height_m, 50) - rx_height_m)) / (299792458e0 / 1.9e9))) AS loss_db FROM links, heights",
    "m": "SELECT rx_height_m, rx_id, CASE WHEN min(loss_db) BETWEEN 60 AND 108 THEN round(min(loss_db), 6) END AS loss_db FROM lossy GROUP BY ALL",
    "inside": """SELECT p.id, e.poly_id FROM pts p JOIN edges e ON true GROUP BY p.id, e.poly_id HAVING
        sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0) THEN 1 ELSE 0 END) % 2 = 1
        OR bool_or(abs((e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1)) < 1e-6 AND p.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))""",
    "cdf": "SELECT rx_height_m, v, sum(c) OVER (PARTITION BY rx_height_m ORDER BY v) / n AS p FROM (SELECT rx_height_m, loss_db AS v, count(*) AS c FROM m WHERE loss_db IS NOT NULL GROUP BY ALL) JOIN (SELECT rx_height_m, count(*)::DOUBLE AS n FROM m GROUP BY ALL) USING (rx_height_m) UNION ALL SELECT rx_height_m, min(loss_db), 0 FROM m GROUP BY rx_height_m HAVING min(loss_db) IS NOT NULL",
}
NEEDS = {"links": ("towers", "rx"), "lossy": ("links", "heights"), "m": ("lossy",), "cdf": ("m",), "inside": ("edges",)}


def with_(*names: str, **own: str) -> str:
    """A WITH clause holding the named fixtures and what they need; own: further ones, before `inside`."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        if n != "inside":
            add(n)
    if "inside" in names:
        add("edges")
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in own.items()]
    if "inside" in names:
        parts.append(f"inside AS ({SQL['inside']})")
    return "WITH " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def towers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("tower_id"), (k * 7919 % 1000 * 100.0).alias("x"), (k * 104729 % 1000 * 100.0).alias("y"), F.when(k % 5 != 0, k % 80 + 20.0).alias("height_m"))


def towers_new(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k0"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    return n.select((F.col("k0") * 3 + F.col("k")).alias("tower_id"), (F.col("k0") * 3571 % 1000 * 100.0 + F.col("k") * 37.5).alias("x"), (F.col("k0") * 2741 % 1000 * 100.0).alias("y"), (F.col("k") + 30.0).alias("height_m"))


def rx(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("rx_id"), (k * 6151 % 1000 * 100.0 + 50 + F.floor(k / 1000) * 25).alias("x"), (k * 3079 % 1000 * 100.0 + 50).alias("y"))


def raster(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    row, col = F.floor(k / 50), k % 50
    return table(spark, d, "part").select(row.alias("row"), col.alias("col"), (col * RES).alias("x"), (row * RES).alias("y"), (F.col("p_retailprice") % 97).alias("z"), F.col("p_size").cast("double").alias("ele"))


def rsrp(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("event_type").alias("carrier"), (F.lit(-60.0) - k * 37 % 60).alias("rsrp_dbm"), (k % 100 / 1000.0 + 40).alias("lat"), (k % 77 / 1000.0 - 105).alias("lon"))


def polygons(spark: SparkSession, only: int | None = None) -> DataFrame:
    rows = [(k, [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items() if only in (None, k)]
    return spark.createDataFrame(rows, "poly_id int, ring array<struct<x:double,y:double>>")
