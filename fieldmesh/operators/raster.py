"""Raster lookups and tile bookkeeping. A raster is long: row, col, x, y, z, ele; cells lie `res` apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmesh.functions.geo import to_tm

from . import ragged
from .ranges import ranked

#: Cells on a block's side, and its halo: rows (and columns) before and after its own that are known to it as well. With two
#: before and three after, the nearest cell of any of its places is in it.
BLOCK, BEFORE, AFTER = 32, 2, 3
#: Blocks on the side of a zone, by which stored blocks are parted.
ZONE = 16
#: Bytes of blocks that each task may hold as a whole; samples of links that are made together, about.
HELD, TOGETHER = 32 << 20, 1 << 22


def blocks(raster: DataFrame, value: str = "z", side: int = BLOCK) -> DataFrame:
    """One row per block: (block_row, block_col, cells), cells a dense array, row after row, halo included.

    A cell goes to its own block, and to a neighbour only from within its halo.
    """
    of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - AFTER) / side), F.floor((F.col(c) + BEFORE) / side)))
    return _filled(raster.withColumn("block_row", of("row")).withColumn("block_col", of("col")), value, side)


def _filled(marked: DataFrame, value: str, side: int) -> DataFrame:
    """The blocks of cells (row, col, value) that stand once for each block (block_row, block_col) that they are in."""
    r = marked.select("block_row", "block_col", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))
    width = side + BEFORE + AFTER
    at = (F.col("row") - F.col("block_row") * side + BEFORE) * width + F.col("col") - F.col("block_col") * side + BEFORE
    r = r.select("block_row", "block_col", at.cast("int").alias("at"), "v")

    def fill(t: pa.Table) -> pa.Table:
        cells, known = np.zeros(width**2), np.zeros(width**2, bool)
        v = t.column("v")
        own = ~v.is_null().to_numpy(zero_copy_only=False) if isinstance(v, pa.Array) else ~v.is_null().combine_chunks().to_numpy(zero_copy_only=False)
        at = t.column("at").to_numpy()[own]
        cells[at], known[at] = v.to_numpy()[own], True
        row = pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), pa.array(cells, mask=~known))
        return pa.table([t.column("block_row").slice(0, 1), t.column("block_col").slice(0, 1), row], ["block_row", "block_col", "cells"])

    return r.groupBy("block_row", "block_col").applyInArrow(fill, "block_row long, block_col long, cells array<double>")


def _zones(df: DataFrame) -> DataFrame:
    return df.withColumn("zone_row", F.floor(F.col("block_row") / ZONE)).withColumn("zone_col", F.floor(F.col("block_col") / ZONE))


def store_blocks(raster: DataFrame, path: str, value: str = "z", side: int = BLOCK) -> None:
    """The blocks of a raster, parted by zone under `path`/blocks, and a small table of zones under `path`/zones.

    A zone's row has its place, its folder relative to `path`, the blocks it has, and the range of block rows and columns.
    """
    b = _zones(blocks(raster, value, side))
    b.repartition("zone_row", "zone_col").sortWithinPartitions("block_row", "block_col").write.partitionBy("zone_row", "zone_col").parquet(f"{path}/blocks")
    z = raster.sparkSession.read.parquet(f"{path}/blocks").groupBy("zone_row", "zone_col").agg(
        F.count("*").alias("n_blocks"), F.min("block_row").alias("lo_row"), F.max("block_row").alias("hi_row"), F.min("block_col").alias("lo_col"), F.max("block_col").alias("hi_col")
    )
    folder = F.concat(F.lit("blocks/zone_row="), F.col("zone_row"), F.lit("/zone_col="), F.col("zone_col"))
    z.withColumn("path", folder).coalesce(1).write.parquet(f"{path}/zones")


class StoredBlocks:
    """Blocks that store_blocks wrote; lookups read the zones that their samples touch, and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.zones = spark.read.parquet(f"{path}/zones")
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.extent = self.zones.agg(F.min("lo_row"), F.max("hi_row"), F.min("lo_col"), F.max("hi_col")).first()

    def near(self, places: DataFrame) -> DataFrame:
        """The blocks of the zones that places (block_row, block_col) are in: partitions are pruned when the places are known."""
        lo_row, hi_row, lo_col, hi_col = (v if v is not None else 0 for v in self.extent)
        # places off the raster ask for no zone
        on = F.col("block_row").between(lo_row, hi_row) & F.col("block_col").between(lo_col, hi_col)
        asked = _zones(places.filter(on).select("block_row", "block_col")).select("zone_row", "zone_col").distinct()
        # one row for a zone at most
        return self.blocks.join(F.broadcast(asked), ["zone_row", "zone_col"], "left_semi").select("block_row", "block_col", "cells")


def _asked_blocks(asked: DataFrame, n: int, raster: DataFrame | StoredBlocks, value: str, side: int) -> DataFrame:
    """The blocks of n distinct asked ones (block_row, block_col) that there are, and no others."""
    from .spatial import sized

    if isinstance(raster, StoredBlocks):
        return raster.near(asked)
    of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - AFTER) / side), F.floor((F.col(c) + BEFORE) / side)))
    marked = raster.withColumn("block_row", of("row")).withColumn("block_col", of("col"))
    return _filled(marked.join(sized(asked, n, 40), ["block_row", "block_col"], "left_semi"), value, side)


def _with_cells(places: DataFrame, raster: DataFrame | StoredBlocks, value: str, side: int) -> DataFrame:
    """places (block_row, block_col, ...) with the cells of their block; null where there is none.

    Only blocks that places are in are made. Few of them are broadcast, and places are not moved; else a block that many places are
    in is dealt, with them, to many owners.
    """
    from .scratch import cut_lineage
    from .spatial import SMALL, balanced_join

    asked = cut_lineage(places.select("block_row", "block_col").distinct(), "asked")
    n = asked.count()
    own = _asked_blocks(asked, n, raster, value, side)
    few = n * (side + BEFORE + AFTER) ** 2 * 8 <= SMALL
    if few:
        return places.join(F.broadcast(own), ["block_row", "block_col"], "left")
    nowhere = places.filter("block_row IS NULL OR block_col IS NULL").withColumn("cells", F.lit(None).cast("array<double>"))
    return balanced_join(places, asked.join(own, ["block_row", "block_col"], "left"), ["block_row", "block_col"]).unionByName(nowhere)


def _at(r: Column, c: Column, side: int) -> Column:
    """The place of a cell in the array of the block that has it as its own; neighbours lie around it."""
    width = side + BEFORE + AFTER
    return (r - F.floor(r / side) * side + BEFORE) * width + c - F.floor(c / side) * side + BEFORE


def _bilinear(x: Column, y: Column, res: float, side: int) -> Column:
    """The value at a place from the `cells` of its block; null beside missing cells."""
    fx, fy = x / res, y / res
    c, r = F.floor(fx).cast("long"), F.floor(fy).cast("long")
    tx, ty = fx - F.floor(fx), fy - F.floor(fy)
    at = _at(r, c, side)
    cell = lambda i, k: F.get("cells", (at + i * (side + BEFORE + AFTER) + k).cast("int"))
    along = lambda a, b, t: F.when(t == 0, a).otherwise(a * (F.lit(1.0) - t) + b * t)
    return along(along(cell(0, 0), cell(0, 1), tx), along(cell(1, 0), cell(1, 1), tx), ty)


def _with_block(samples: DataFrame, res: float, side: int) -> DataFrame:
    return samples.withColumn("block_row", F.floor(F.floor(F.col("y") / res) / side)).withColumn("block_col", F.floor(F.floor(F.col("x") / res) / side))


def bilinear_lookup(samples: DataFrame, raster: DataFrame | StoredBlocks, res: float, value: str = "z", side: int = BLOCK) -> DataFrame:
    """Adds `value` to samples (x, y) by bilinear interpolation; null outside or beside missing cells."""
    s = _with_block(samples, res, side)
    j = _with_cells(s, raster, value, side)
    return j.withColumn(value, _bilinear(F.col("x"), F.col("y"), res, side)).drop("block_row", "block_col", "cells")


def nearest_cell_lookup(samples: DataFrame, raster: DataFrame | StoredBlocks, res: float, value: str = "z", side: int = BLOCK) -> DataFrame:
    """Adds the value of the nearest known cell within two cells of the rounded place; ties to the lower row, then column.

    A sample looks into the block that it is in once: the block's halo has every cell that may be nearest.
    """
    # each sample is compared with 25 cells: dealt out evenly, however few files they come from
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = _with_block(samples.repartition(tasks, *[F.col(f"`{c}`") for c in samples.columns]), res, side)
    j = _with_cells(s, raster, value, side)
    c, r = F.floor(F.col("x") / res).cast("long"), F.floor(F.col("y") / res).cast("long")
    at, row, col = _at(r, c, side), F.round(F.col("y") / res).cast("long"), F.round(F.col("x") / res).cast("long")

    def cell(i: int, k: int) -> Column:
        rr, cc = row + i, col + k
        d = (F.col("x") - cc * res) * (F.col("x") - cc * res) + (F.col("y") - rr * res) * (F.col("y") - rr * res)
        v = F.get("cells", (at + (rr - r) * (side + BEFORE + AFTER) + cc - c).cast("int"))
        return F.when(v.isNotNull(), F.struct(d.alias("d"), rr.alias("row"), cc.alias("col"), v.alias("v")))

    around = F.array(*[cell(i, k) for i in range(-2, 3) for k in range(-2, 3)])
    best = F.array_min(F.filter(around, lambda q: q.isNotNull()))
    return j.withColumn(value, best["v"]).drop("block_row", "block_col", "cells")


def with_fallback(samples: DataFrame, fallback: DataFrame, key: str, values: tuple[str, ...] = ("z", "ele")) -> DataFrame:
    f = fallback.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    j = samples.join(f, key, "left")
    return j.select(*[c for c in samples.columns if c not in values], *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def apply_ground_mask(samples: DataFrame, masks: DataFrame, id_col: str) -> DataFrame:
    """Inside a mask polygon the surface is the ground."""
    from .spatial import points_in_polygon

    hit = points_in_polygon(samples, masks, id_col).select(id_col).distinct().withColumn("_in", F.lit(True))
    j = samples.join(hit, id_col, "left")
    return j.withColumn("z", F.when(F.col("_in"), F.col("ele")).otherwise(F.col("z"))).drop("_in")


def tile_footprint(raster: DataFrame, tile: str = "tile") -> DataFrame:
    """Each tile's box, grown by half the smallest spacing of its samples."""
    gaps = None
    for c in ("x", "y"):
        d = raster.select(tile, F.col(c).alias("v")).distinct()
        g = d.withColumn("gap", F.col("v") - F.lag("v").over(W.partitionBy(tile).orderBy("v"))).groupBy(tile).agg(F.min("gap").alias("gap"))
        gaps = g if gaps is None else gaps.unionByName(g)
    half = gaps.groupBy(tile).agg((F.min("gap") / 2.0).alias("half"))
    box = raster.groupBy(tile).agg(F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y"))
    return box.join(half, tile).select(tile, (F.col("lo_x") - F.col("half")).alias("lo_x"), (F.col("hi_x") + F.col("half")).alias("hi_x"), (F.col("lo_y") - F.col("half")).alias("lo_y"), (F.col("hi_y") + F.col("half")).alias("hi_y"))


def assign_tile(samples: DataFrame, footprints: DataFrame, id_col: str, res: float, size: float) -> DataFrame:
    """The tile that holds a sample, else the nearest within sqrt(2)/2 of the resolution; lowest name on ties. size: a tile's width."""
    reach = res * 2**0.5 / 2
    cell = lambda c: F.floor(c / size).cast("long")
    f = footprints.withColumn("_cx", F.explode(F.sequence(cell(F.col("lo_x") - reach), cell(F.col("hi_x") + reach)))).withColumn("_cy", F.explode(F.sequence(cell(F.col("lo_y") - reach), cell(F.col("hi_y") + reach))))
    s = samples.select(id_col, "x", "y").withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    off = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    d = F.sqrt(F.pow(off("x", "lo_x", "hi_x"), F.lit(2.0)) + F.pow(off("y", "lo_y", "hi_y"), F.lit(2.0)))
    j = s.join(f, ["_cx", "_cy"]).withColumn("_d", d).filter(F.col("_d") <= reach)
    best = j.groupBy(id_col).agg(F.min(F.struct("_d", "tile")).alias("m"))
    return samples.join(best.select(id_col, F.col("m.tile").alias("tile")), id_col, "left")


def assign_tile_multi_crs(samples: DataFrame, tiles: DataFrame, id_col: str) -> DataFrame:
    """The tile that holds a sample (lat, lon), each tile judged in its own projection; an error where two tiles hold one.

    tiles: (tile, lat0, lon0, scale, false_x, false_y, ring: closed array of lat, lon); boundaries are straight in the projection,
    and their longitudes run on over no turn. Samples meet tiles in cells as large as the largest tile. Boxes are grown by more
    than a straight side can bulge out of its parallel. No tile, or a null place: null.
    """
    from .spatial import _in_boxes

    own = [F.col(c) for c in ("lat0", "lon0", "scale", "false_x", "false_y")]
    lo = lambda f: F.array_min(F.transform("ring", f))
    hi = lambda f: F.array_max(F.transform("ring", f))
    lat, lon = lambda q: q["lat"], lambda q: q["lon"]
    pad = (F.pow(hi(lat) - lo(lat), F.lit(2.0)) + F.pow(hi(lon) - lo(lon), F.lit(2.0))) * 0.002 + 1e-6
    box = tiles.withColumn("_pad", pad).select(
        "tile", "lat0", "lon0", "scale", "false_x", "false_y", "ring",
        (lo(lon) - F.col("_pad")).alias("lo_x"), (hi(lon) + F.col("_pad")).alias("hi_x"),
        (lo(lat) - F.col("_pad")).alias("lo_y"), (hi(lat) + F.col("_pad")).alias("hi_y"),
    )

    def corner(q: Column) -> Column:
        x, y = to_tm(q["lat"], q["lon"], *own)
        return F.struct(x.alias("x"), y.alias("y"))

    box = box.withColumn("ring", F.transform("ring", corner))
    met = _in_boxes(samples.select(id_col, F.col("lon").alias("x"), F.col("lat").alias("y")), box, 0.0)
    x, y = to_tm(F.col("y"), F.col("x"), *own)
    met = met.select(id_col, "tile", "ring", x.alias("x"), y.alias("y"))
    sides = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    right = lambda a, b: F.col("x") < a["x"] + (F.col("y") - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
    crossed = F.filter(sides, lambda q: ((q["a"]["y"] > F.col("y")) != (q["b"]["y"] > F.col("y"))) & right(q["a"], q["b"]))
    # no filter here: it would be pushed below the projection and project each sample again for every side
    hit = F.when(F.size(crossed) % 2 == 1, F.col("tile"))
    inside = met.groupBy(id_col).agg(F.min(hit).alias("tile"), F.max(hit).alias("_other"))
    one = F.when(F.col("tile").isNull() | (F.col("tile") == F.col("_other")), F.col("tile")).otherwise(F.raise_error(F.lit("a sample lies in two tiles")))
    return samples.join(inside.select(id_col, one.alias("tile")), id_col, "left")


def nearest_tile(samples: DataFrame, centroids: DataFrame, id_col: str, start: float) -> DataFrame:
    """The tile whose centroid (tile, x, y) is nearest; ties to the lower name."""
    from .spatial import nearest

    return nearest(samples, centroids, id_col, "tile", start)


def split_tiles(tiles: DataFrame, anomalies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, anomalous) tiles by a list of names; a listed tile that is not there is an error."""
    missing = anomalies.join(tiles, "tile", "left_anti").select("tile").limit(1).collect()
    if missing:
        raise ValueError(f"listed as anomalous, but no tile: {missing[0]['tile']}")
    return tiles.join(anomalies, "tile", "left_anti"), tiles.join(anomalies, "tile", "left_semi")


#: The parameters of a projection, and how far two equal ones may be apart.
PROJECTION = {"lat0": 1e-10, "lon0": 1e-10, "scale": 1e-8, "false_x": 1e-2, "false_y": 1e-2}


def attach_crs(tiles: DataFrame, known: DataFrame, fallback: DataFrame) -> DataFrame:
    """tiles with the parameters of PROJECTION and crs, the known projection that equals them within all tolerances, else unknown.

    Parameters that a tile lacks come, all together, from the fallback list (tile, parameters); a name there may have a folder
    and an ending. Of several known projections (crs, parameters) the first by name is taken; differences count on both sides.
    """
    names = list(PROJECTION)
    base = F.regexp_extract("tile", r"([^/\\]+?)(\.[A-Za-z0-9]+)?$", 1)
    f = fallback.select(base.alias("tile"), F.struct(*names).alias("_f")).groupBy("tile").agg(F.min("_f").alias("_f"))
    t = tiles.join(f, "tile", "left")
    whole = F.lit(True)
    for c in names:
        whole &= F.col(c).isNotNull()
    t = t.withColumns({c: F.when(whole, F.col(c)).otherwise(F.col(f"_f.{c}")) for c in names}).drop("_f")
    # a known projection stands in its own cells and their neighbours, so no rounding edge parts a pair
    cell = lambda c, tol: F.floor(c / (tol * 4.0)).cast("long")
    key = {"lat0": "_k1", "lon0": "_k2", "false_x": "_k3"}
    k = known.select("crs", *[F.col(c).alias(f"k_{c}") for c in names])
    for c, name in key.items():
        at = cell(F.col(f"k_{c}"), PROJECTION[c])
        k = k.withColumn(name, F.explode(F.array(at - 1, at, at + 1)))
    near = F.lit(True)
    for c, tol in PROJECTION.items():
        near &= F.abs(F.col(c) - F.col(f"k_{c}")) <= tol
    t = t.withColumns({name: cell(F.col(c), PROJECTION[c]) for c, name in key.items()})
    hit = t.join(k, list(key.values())).filter(near).groupBy("tile").agg(F.min("crs").alias("crs"))
    return t.drop(*key.values()).join(hit, "tile", "left").withColumn("crs", F.coalesce("crs", F.lit("unknown")))


#: Distinct projections that a vote may be about; tiles are counted before, however many there are.
VOTED = 10_000


def vote_crs(tiles: DataFrame) -> DataFrame:
    """The projection that most tiles have: (name, method, unit, parameters, n) of its first tile, one row.

    tiles: (tile, name, method, unit, parameters). In the order of tiles, a projection is one seen before if the name is the same, or
    the method, the unit and all parameters are; the first seen wins ties. Tiles are counted by projection first; more than VOTED
    projections are an error.
    """
    own = ["name", "method", "unit", *PROJECTION]
    g = tiles.groupBy(*own).agg(F.count("*").alias("n"), F.min("tile").alias("first_tile"))
    if g.limit(VOTED + 1).count() > VOTED:
        raise ValueError(f"more than {VOTED} projections")
    kinds = {f.name: f.dataType.simpleString() for f in g.schema}

    def elect(t: pd.DataFrame) -> pd.DataFrame:
        kinds_of = [tuple(None if pd.isna(v) else v for v in r) for r in t[["method", "unit", *PROJECTION]].itertuples(index=False)]
        rows = sorted(zip(t["first_tile"], t["name"], kinds_of, t["n"], range(len(t)), strict=True), key=lambda r: r[0])
        by_name, by_kind, count, first = {}, {}, {}, {}
        for _, name, kind, n, i in rows:
            seen = min((d[k] for d, k in ((by_name, name), (by_kind, kind)) if k in d), default=None)
            if seen is None:
                seen = len(first)
                first[seen] = i
                # only the first of a projection stands for it
                by_name.setdefault(name, seen)
                by_kind.setdefault(kind, seen)
            count[seen] = count.get(seen, 0) + int(n)
        best = min(count, key=lambda k: (-count[k], k))
        out = t.iloc[[first[best]]][own].copy()
        out["n"] = count[best]
        return out

    # one small group: distinct projections
    return g.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(elect, ", ".join(f"{c} {kinds[c]}" for c in [*own, "n"]))


def downsample(raster: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column."""
    return raster.filter((F.col("row") % n == 0) & (F.col("col") % n == 0))


def every_nth(points: DataFrame, n: int, *order: str) -> DataFrame:
    """Every n-th point in the given order, the first one included; ranked range by range."""
    return ranked(points, [F.col(c) for c in order], "_rank").filter((F.col("_rank") - 1) % n == 0).drop("_rank")


def trim_raster(raster: DataFrame, lo_x: float, hi_x: float, lo_y: float, hi_y: float) -> DataFrame:
    """An open range."""
    return raster.filter((F.col("x") > lo_x) & (F.col("x") < hi_x) & (F.col("y") > lo_y) & (F.col("y") < hi_y))


def with_altitude(towers: DataFrame, raster: DataFrame, res: float) -> DataFrame:
    t = bilinear_lookup(towers, raster, res, "ele")
    return t.withColumn("alt_m", F.col("ele") + F.col("height_m")).withColumn("height_again_m", F.col("alt_m") - F.col("ele"))


def sort_grid(grid: DataFrame) -> DataFrame:
    return grid.dropDuplicates(["x", "y"]).orderBy(F.asc("x"), F.desc("y"))


def structure_height(z: Column, ele: Column) -> Column:
    return z - ele


def log_blockage(d: Column) -> Column:
    return F.log10(F.nullif(d, F.lit(0.0)))


class _Cells:
    """Blocks in one array; heights between cells by bilinear interpolation."""

    def __init__(self, t: pa.Table, side: int):
        width = side + BEFORE + AFTER
        self.side, self.width, n = side, width, t.num_rows
        rows, cols = (ragged.whole(t, c).to_numpy().astype(np.int64) for c in ("block_row", "block_col"))
        cells = ragged.whole(t, "cells").flatten()
        # one more block, of nothing
        self.known = np.zeros((n + 1) * width**2, bool)
        self.known[: n * width**2] = ~cells.is_null().to_numpy(zero_copy_only=False)
        self.cells = np.full((n + 1) * width**2, np.nan)
        self.cells[: n * width**2] = cells.to_numpy(zero_copy_only=False)
        self.row, self.col = self._axis(rows), self._axis(cols)
        # the last row and column are of blocks that are not there
        self.first = np.full((self.row[1].max() + 2, self.col[1].max() + 2), n * width**2, np.int64)
        self.first[self.row[1][rows - self.row[0] + 1], self.col[1][cols - self.col[0] + 1]] = np.arange(n) * width**2

    @staticmethod
    def _axis(k: np.ndarray) -> tuple[int, np.ndarray]:
        """The lowest number, and the places of the numbers from the one before it to the one after the highest; -1 for none."""
        if not len(k):
            return 0, np.full(2, -1)
        own, lo = np.unique(k), int(k.min())
        at = np.full(int(k.max()) - lo + 3, -1)
        at[own - lo + 1] = np.arange(len(own))
        return lo, at

    def _find(self, axis: tuple[int, np.ndarray], block: np.ndarray) -> np.ndarray:
        lo, at = axis
        return at[np.clip(block - (lo - 1), 0, len(at) - 1).astype(np.int64)]

    def heights(self, fx: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """(heights, where there is none or None, block rows, block columns) at places in cells."""
        c, r = np.floor(fx), np.floor(fy)
        tx, ty = fx - c, fy - r
        block_row, block_col = np.floor(r / self.side), np.floor(c / self.side)
        at = (r - block_row * self.side + BEFORE) * self.width + (c - block_col * self.side + BEFORE)
        at = self.first[self._find(self.row, block_row), self._find(self.col, block_col)] + at.astype(np.int64)
        got = [self.cells[at + k] for k in (0, 1, self.width, self.width + 1)]
        sx, sy = 1.0 - tx, 1.0 - ty
        z = (got[0] * sx + got[1] * tx) * sy + (got[2] * sx + got[3] * tx) * ty
        odd = np.flatnonzero(np.isnan(z))
        unknown = None
        if len(odd):
            # beside a missing cell: it counts only where its weight is not 0
            at, tx, ty = at[odd], tx[odd], ty[odd]
            a, b, d, e = (v[odd] for v in got)
            ka, kb, kd, ke = (self.known[at + k] for k in (0, 1, self.width, self.width + 1))
            along = lambda a, ka, b, kb, t: (np.where(t == 0, a, a * (1.0 - t) + b * t), np.where(t == 0, ka, ka & kb))
            z[odd], own = along(*along(a, ka, b, kb, tx), *along(d, kd, e, ke, tx), ty)
            if not own.all():
                unknown = np.zeros(len(z), bool)
                unknown[odd] = ~own
        return z, unknown, block_row, block_col


def _profiled(t: pa.Table | pa.RecordBatch, cells: _Cells, res: float, own: list[str], runs: bool) -> pa.Table:
    """The links (own columns) with profile and n_known; with runs, (own, runs): their heights in pieces, one for each block on the way."""
    start_x, start_y, x, y = (ragged.doubles(ragged.whole(t, c)) for c in ("tx_x", "tx_y", "x", "y"))
    n = ragged.whole(t, "_n").to_numpy().astype(np.int64)
    dx, dy, known = x - start_x, y - start_y, n.copy()
    z, unknown, new = np.empty(n.sum()), None, np.zeros(n.sum() if runs else 0, bool)
    for lo, hi, a, b in ragged.passes(n):
        m = n[lo:hi]
        i = ragged.places(m)
        share = i / np.repeat(m - 1.0, m)
        fx = (np.repeat(start_x[lo:hi], m) + np.repeat(dx[lo:hi], m) * share) / res
        fy = (np.repeat(start_y[lo:hi], m) + np.repeat(dy[lo:hi], m) * share) / res
        z[a:b], lost, row, col = cells.heights(fx, fy)
        if lost is not None:
            unknown = np.zeros(len(z), bool) if unknown is None else unknown
            unknown[a:b] = lost
            known[lo:hi] -= ragged.by_row(np.add, lost.astype(np.int64), m, 0)
        if runs:
            new[a:b] = (i == 0) | np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1]))
    heights = pa.array(z, mask=unknown)
    if runs:
        at = np.flatnonzero(new)
        pieces = pa.StructArray.from_arrays([pa.array(ragged.places(n)[at].astype(np.int32)), ragged.lists(np.diff(np.append(at, len(z))), heights)], ["_first", "z"])
        lists = ragged.lists(ragged.by_row(np.add, new.astype(np.int64), n, 0), pieces)
        return pa.table([*[t.column(c) for c in own], lists], [*own, "runs"])
    return pa.table([*[t.column(c) for c in own], ragged.lists(n, heights), pa.array(known.astype(np.int32))], [*own, "profile", "n_known"])


def profiles(links: DataFrame, raster: DataFrame | StoredBlocks, res: float, step: float, min_n: int = 10, value: str = "z", side: int = BLOCK, again: DataFrame | None = None) -> DataFrame:
    """Adds a profile array to links, and n_known, how many of its heights are known. Links without a key are left out.

    Heights are computed for a batch of links at a time, from the blocks that links may cross: all of them in every task where they
    are few, and links are not moved; else links go, with others that start in the same block, to the blocks around.
    again: the rx_id that several links of a tower may have; looked for where not given. What links of the same keys find is put
    together, by blocks, in a profile that they share.
    """
    from .scratch import cut_lineage
    from .spatial import sized

    n = F.greatest(F.ceil(F.col("dist_m") / step), F.lit(min_n)).cast("int")
    keyed = links.filter("tower_id IS NOT NULL AND rx_id IS NOT NULL")
    if again is None:
        again = keyed.groupBy("tower_id", "rx_id").agg(F.count("*").alias("n")).filter("n > 1").select("rx_id").distinct()
    again = cut_lineage(again, "again")
    n_again = again.count()
    block = lambda c: F.floor(F.floor(F.col(c) / res) / side)
    ends = {"_row": "tx_y", "_col": "tx_x", "_row2": "y", "_col2": "x"}
    met = cut_lineage(keyed.select(n.alias("_n"), *[block(c).alias(k) for k, c in ends.items()]).groupBy(*ends).agg(F.sum("_n").alias("n")), "met")
    span = lambda a, b: F.explode(F.sequence(F.least(a, b), F.greatest(a, b)))
    crossed = met.withColumn("block_row", span("_row", "_row2")).withColumn("block_col", span("_col", "_col2"))
    asked = cut_lineage(crossed.select("block_row", "block_col").distinct(), "asked")
    n_asked = asked.count()
    own = _asked_blocks(asked, n_asked, raster, value, side).select("block_row", "block_col", "cells")
    todo = keyed.withColumn("_n", n)
    kinds = lambda names: ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in names)
    if n_asked * (side + BEFORE + AFTER) ** 2 * 8 <= HELD:
        held = links.sparkSession.sparkContext.broadcast(_Cells(own.toArrow(), side))

        def heights(df: DataFrame, own: list[str], more: str) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for lo, hi, *_ in ragged.passes(b.column("_n").to_numpy().astype(np.int64), TOGETHER):
                        yield from _profiled(b.slice(lo, hi - lo), held.value, res, own, "runs" in more).to_batches()

            return df.mapInArrow(run, kinds(own) + more)
    else:
        home = ["_row", "_col"]
        parts = met.groupBy(*home).agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("_parts"))
        parts = cut_lineage(parts, "parts")
        n_parts = parts.count()
        needs = crossed.select(*home, "block_row", "block_col").distinct().join(parts, home).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        cells = own.join(needs.drop("_parts"), ["block_row", "block_col"])
        todo = todo.withColumns({k: block(ends[k]) for k in home}).join(sized(parts, n_parts, 40), home)
        todo = todo.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keyed.columns]), F.col("_parts")).cast("int"))

        def heights(df: DataFrame, own: list[str], more: str) -> DataFrame:
            def run(a: pa.Table, b: pa.Table) -> pa.Table:
                return _profiled(a, _Cells(b, side), res, own, "runs" in more)

            return df.groupBy(*home, "_part").cogroup(cells.groupBy(*home, "_part")).applyInArrow(run, kinds(own) + more)

    profiled = ", profile array<double>, n_known int"
    if not n_again:
        return heights(todo, links.columns, profiled)
    again = sized(again, n_again, 16)
    once = heights(todo.join(again, "rx_id", "left_anti"), links.columns, profiled)
    pieces = heights(todo.join(again, "rx_id", "left_semi"), ["tower_id", "rx_id"], ", runs array<struct<_first:int,z:array<double>>>")
    runs = pieces.groupBy("tower_id", "rx_id").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    got = runs.select("tower_id", "rx_id", F.flatten(F.transform("runs", lambda r: r["z"])).alias("profile"))
    got = got.withColumn("n_known", F.size(F.filter("profile", lambda z: z.isNotNull())))
    shared = keyed.join(again, "rx_id", "left_semi").join(got, ["tower_id", "rx_id"])
    return once.unionByName(shared.select(once.columns))


def in_covered_area(points: DataFrame, footprints: DataFrame, size: float) -> DataFrame:
    """The points for which some tile exists; size: a tile's width."""
    cell = lambda c: F.floor(c / size).cast("long")
    f = footprints.withColumn("_cx", F.explode(F.sequence(cell(F.col("lo_x")), cell(F.col("hi_x"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("lo_y")), cell(F.col("hi_y")))))
    p = points.withColumn("_px", cell(F.col("x"))).withColumn("_py", cell(F.col("y")))
    inside = F.col("x").between(F.col("lo_x"), F.col("hi_x")) & F.col("y").between(F.col("lo_y"), F.col("hi_y"))
    return p.join(f.drop("tile"), (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & inside, "left_semi").drop("_px", "_py")


def surface_difference(raster: DataFrame, reference: DataFrame) -> DataFrame:
    """Surface minus ground of every cell, and ground minus a reference's (row, col, ref_ele); null where one is missing."""
    j = raster.join(reference.select("row", "col", "ref_ele"), ["row", "col"], "left")
    return j.withColumn("surface_m", F.col("z") - F.col("ele")).withColumn("ground_diff_m", F.col("ele") - F.col("ref_ele"))


def difference_summary(diff: DataFrame, *values: str) -> DataFrame:
    """(value, n, lowest, highest, mean) of each difference."""
    rows = F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).alias("d")) for v in values])
    d = diff.select(F.explode(rows).alias("r")).select("r.value", "r.d")
    return d.groupBy("value").agg(F.count("d").alias("n"), F.min("d").alias("lowest"), F.max("d").alias("highest"), F.avg("d").alias("mean"))
