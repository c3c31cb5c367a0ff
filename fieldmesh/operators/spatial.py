"""Spatial joins and polygon predicates, planned as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmesh.functions.geo import EARTH_KM, dist2d, haversine_km

from .scratch import cut_lineage


def _around(c: Column) -> Column:
    return F.array(c - 1, c, c + 1)


#: Rows of one side that an owner takes, about; how often a crowded cell is quartered; bytes of a side that may be broadcast.
CROWD, QUARTERS, SMALL = 8192, 6, 8 << 20


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marked for broadcast if so many rows are small; else merged, as the planner's own estimate does not see what explode adds."""
    return F.broadcast(df) if rows * row_bytes <= SMALL else df.hint("merge")


def _over(df: DataFrame, keys: list[str], crowd: int) -> DataFrame | None:
    """(keys, n) of the keys with more than `crowd` rows, written; None where there are none."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    return cut_lineage(n, "crowded") if n.limit(1).count() else None


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], near: Column | None = None, crowd: int | None = None) -> DataFrame:
    """left and right joined on their keys (and where `near` holds), a crowded key by many owners.

    A key with more than `crowd` rows on a side has them dealt to parts by the rows' hashes. Every part of one side meets every
    part of the other in one owner, so each pair comes once; a row is copied as often as the other side has parts.
    """
    crowd = crowd or CROWD
    over = [_over(side, keys, crowd) for side in (left, right)]
    if over == [None, None]:
        # both sides may be many times their input, which the planner does not see and would broadcast
        j = left.join(right.hint("merge"), keys)
        return j if near is None else j.filter(near)
    parts = None
    for name, o in zip(("_ka", "_kb"), over, strict=True):
        k = o.select(*keys, F.ceil(F.col("n") / crowd).cast("int").alias(name)) if o is not None else None
        parts = k if parts is None else parts if k is None else parts.join(k, keys, "full")
    for name in ("_ka", "_kb"):
        parts = parts.withColumn(name, F.coalesce(F.col(name), F.lit(1)) if name in parts.columns else F.lit(1))
    parts = cut_lineage(parts, "parts")
    n, sides = parts.count(), []
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side, own, other, k_own, k_other in ((left, "_i", "_j", "_ka", "_kb"), (right, "_j", "_i", "_kb", "_ka")):
        at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns]), F.coalesce(k_own, F.lit(1))).cast("int")
        met = side.join(sized(parts, n, 64), keys, "left")
        met = met.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(k_other, F.lit(1)) - 1)))
        # a stated number: small inputs of many pairs are not put together again
        sides.append(met.drop("_ka", "_kb").repartition(tasks, *keys, "_i", "_j"))
    j = sides[0].join(sides[1], [*keys, "_i", "_j"]).drop("_i", "_j")
    return j if near is None else j.filter(near)


def _quartered(a: DataFrame, r: float) -> list[tuple[DataFrame, int]]:
    """The crowded cells of each level and their number: level k has cells of r / 2 ** k in the crowded ones of level k - 1."""
    out, todo = [], a.select("x", "y")
    for level in range(QUARTERS):
        side = r / 2**level
        todo = todo.withColumn("_lx", F.floor(F.col("x") / side).cast("long")).withColumn("_ly", F.floor(F.col("y") / side).cast("long"))
        over = _over(todo.filter("_lx IS NOT NULL AND _ly IS NOT NULL"), ["_lx", "_ly"], CROWD)
        if over is None:
            break
        out.append((over.drop("n"), over.count()))
        todo = todo.join(sized(*out[-1], 32), ["_lx", "_ly"], "left_semi").select("x", "y")
    return out


def range_join(a: DataFrame, b: DataFrame, radius: float, strict: bool = False, by: str | None = None, most: int | None = None) -> DataFrame:
    """All pairs of a and b (columns x, y; b's prefixed with b_) within a planar distance, with dist_m.

    A small b is broadcast by cells as wide as the radius, and a is dealt out evenly: pairs are many more than rows. Else a's cells
    are quartered while they hold more than CROWD of its rows, so cells are small where a is dense; every cell of a meets the rows of
    b that its box is near to. Rows that no quartering parts, and cells to which b crowds, are dealt to many owners
    (balanced_join). A pair has one owner, as a's row lies in one cell. Rows without a place pair with nothing.
    by: a key of a, by which a is dealt out where b is small, so that a join of the pairs on it moves none of them. most: rows of a
    times rows of b that a task takes there, about, for pairs that are sorted; a is counted.
    """
    r = float(radius)
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    cell = lambda c, side: F.floor(F.col(c) / side).cast("long")
    right = right.withColumn("_lx", F.explode(_around(cell("b_x", r)))).withColumn("_ly", F.explode(_around(cell("b_y", r))))
    d = dist2d(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
    near = d < r if strict else d <= r
    n = b.count()
    if n * 9 * 16 * len(right.columns) <= SMALL:
        tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.count() * n // most + 1 if most else 1)
        a = a.repartition(tasks, *[F.col(f"`{c}`") for c in ([by] if by else a.columns)])
        out = a.withColumn("_lx", cell("x", r)).withColumn("_ly", cell("y", r)).join(F.broadcast(right), ["_lx", "_ly"]).filter(near)
        return out.withColumn("dist_m", d).drop("_lx", "_ly")
    levels = _quartered(a, r)
    left, right = a.withColumn("_level", F.lit(0)), right.withColumn("_level", F.lit(0))
    for k, (over, n) in enumerate(levels):
        side = r / 2**k
        here = sized(over.withColumn("_level", F.lit(k)).withColumn("_full", F.lit(True)), n, 40)
        left = left.withColumn("_lx", cell("x", side)).withColumn("_ly", cell("y", side)).join(here, ["_level", "_lx", "_ly"], "left")
        left = left.withColumn("_level", F.when(F.col("_full"), k + 1).otherwise(F.col("_level"))).drop("_full")
        # b goes on into those quarters of a crowded cell that it is near to
        stay = F.array(F.struct(F.col("_level").alias("level"), F.col("_lx").alias("x"), F.col("_ly").alias("y")))
        down = F.array(*[F.struct(F.lit(k + 1).alias("level"), (F.col("_lx") * 2 + i).alias("x"), (F.col("_ly") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)])
        off = lambda c, at, h=side / 2: F.greatest(at * h - F.col(c), F.col(c) - (at + 1) * h, F.lit(0.0))
        reach = lambda q: F.sqrt(off("b_x", q["x"]) * off("b_x", q["x"]) + off("b_y", q["y"]) * off("b_y", q["y"])) <= r * (1 + 1e-9)  # noqa: B023, E731
        right = right.join(here, ["_level", "_lx", "_ly"], "left").withColumn("_q", F.explode(F.when(F.col("_full"), F.filter(down, reach)).otherwise(stay)))
        right = right.withColumn("_level", F.col("_q.level")).withColumn("_lx", F.col("_q.x")).withColumn("_ly", F.col("_q.y")).drop("_q", "_full")
    side = F.lit(r) / F.pow(F.lit(2.0), F.col("_level"))
    left = left.withColumn("_lx", F.floor(F.col("x") / side).cast("long")).withColumn("_ly", F.floor(F.col("y") / side).cast("long"))
    out = balanced_join(left, right, ["_level", "_lx", "_ly"], near)
    return out.withColumn("dist_m", d).drop("_level", "_lx", "_ly")


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, start: float, limit: float = 1e9) -> DataFrame:
    """a's rows with the nearest b (b_id, dist_m), ties to the smallest id.

    Cells start at `start` metres, or at less where b is dense; rows without a hit within a cell's width try cells four times as
    wide, so the last, widest rounds are for few rows. Equal places of a side are looked for, or found, once.
    """
    own = _places(b, b_id, "x", "y")
    n, w, h = own.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return _widening(a, ("x", "y"), b_id, _dense(start, (w or 0.0) * (h or 0.0), n), limit, lambda left, r: range_join(left, own, r))


def _places(b: DataFrame, b_id: str, *place: str) -> DataFrame:
    """The distinct places of b, each with its smallest id, written."""
    return cut_lineage(b.dropna(subset=list(place)).groupBy(*place).agg(F.min(b_id).alias(b_id)), "places")


def _dense(start: float, area: float, n: int) -> float:
    """A first radius of twice the mean spacing of n places, at most `start`, and not less than a 64th of it."""
    return min(start, max(2.0 * math.sqrt(area / n), start / 64.0)) if n else start


def nearest_geo(a: DataFrame, b: DataFrame, a_id: str, b_id: str, start_km: float) -> DataFrame:
    """The same for (lat, lon) by great-circle distance; dist_m. The last round's cells span the sphere."""
    own = _places(b, b_id, "lat", "lon")
    start = _dense(start_km * 1000.0, 4.0 * math.pi * (EARTH_KM * 1000.0) ** 2, own.count())
    return _widening(a, ("lat", "lon"), b_id, start, 21_000_000.0, lambda left, r: geo_join(left, own, r))


def geo_join(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """All pairs of a and b (lat, lon; b's prefixed with b_) within a great-circle distance in metres, with dist_m.

    Cells are bands of latitude as wide as the radius, cut by longitude so that a neighbour reaches no further than the
    next cell; b is put into its nine neighbours, and once more across the date line.
    """
    high = radius / 1000.0 / EARTH_KM * 180.0 / math.pi
    band = lambda lat: F.floor((lat + 90.0) / high).cast("long")
    # a radius spans most degrees of longitude at a band's end nearer to the pole
    edge = lambda k: F.least(F.greatest(F.abs(k * high - 90.0), F.abs((k + 1) * high - 90.0)) + high, F.lit(89.999))
    wide = lambda k: F.least(F.lit(high) / F.cos(F.radians(edge(k))), F.lit(400.0)) * 1.6
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_band", F.explode(_around(band(F.col("b_lat")))))
    turned = F.explode(F.array(*[F.col("b_lon") + turn for turn in (-360.0, 0.0, 360.0)]))
    right = right.withColumn("_turned", turned).withColumn("_wide", wide(F.col("_band"))).filter(F.abs("_turned") <= F.lit(180.0) + F.col("_wide"))
    right = right.withColumn("_cell", F.explode(_around(F.floor(F.col("_turned") / F.col("_wide")).cast("long")))).drop("_wide")
    left = a.withColumn("_band", band(F.col("lat"))).withColumn("_cell", F.floor(F.col("lon") / wide(F.col("_band"))).cast("long"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")) * 1000.0
    once = F.abs(F.col("lon") - F.col("_turned")) <= 180.0
    return balanced_join(left, right, ["_band", "_cell"]).withColumn("dist_m", d).filter((F.col("dist_m") <= radius) & once).drop("_band", "_cell", "_turned")


def _widening(a: DataFrame, place: tuple[str, str], b_id: str, start: float, limit: float, pairs: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    # rows without a place find nothing, and no round looks for them
    at = list(place)
    left, out, r = cut_lineage(a.select(*at).dropna().distinct(), "places"), None, float(start)
    while True:
        hit = pairs(left, r).groupBy(*at).agg(F.min(F.struct("dist_m", F.col(f"b_{b_id}").alias("id"))).alias("m"))
        hit = cut_lineage(hit.select(*at, F.col("m.id").alias(f"nearest_{b_id}"), F.col("m.dist_m").alias("dist_m")), "nearest")
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit, at, "left_anti")
        if r >= limit or not left.limit(1).count():
            return a.join(out, at, "left").select(*a.columns, f"nearest_{b_id}", "dist_m")
        r *= 4


def edges_of(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """(poly_id, seq, x1, y1, x2, y2) from (poly_id, ring: array of x, y)."""
    e = polygons.select("poly_id", F.posexplode(F.slice(ring, 1, F.size(ring) - 1)).alias("seq", "p"), F.col(ring).alias("r"))
    q = F.element_at("r", F.col("seq") + 2)
    return e.select("poly_id", "seq", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def _on_edge(tol: float) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    near = F.abs(dx * (F.col("y") - F.col("y1")) - dy * (F.col("x") - F.col("x1"))) <= tol * F.greatest(F.lit(1.0), F.abs(dx) + F.abs(dy))
    return near & F.col("x").between(F.least("x1", "x2") - tol, F.greatest("x1", "x2") + tol) & F.col("y").between(F.least("y1", "y2") - tol, F.greatest("y1", "y2") + tol)


def _in_boxes(points: DataFrame, box: DataFrame, tol: float) -> DataFrame:
    """The points (x, y) with the poly_id of every box that holds them."""
    side = box.agg(F.max(F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")))).first()[0] or 1.0
    cell = lambda c: F.floor(c / float(side)).cast("long")
    reach = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo) - tol), cell(F.col(hi) + tol)))
    b = box.withColumn("_cx", reach("lo_x", "hi_x")).withColumn("_cy", reach("lo_y", "hi_y"))
    p = points.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    inside = F.col("x").between(F.col("lo_x") - tol, F.col("hi_x") + tol) & F.col("y").between(F.col("lo_y") - tol, F.col("hi_y") + tol)
    return p.join(b, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy", "lo_x", "hi_x", "lo_y", "hi_y")


#: Cells along the longer side of a polygon's box, at most; columns of a mask.
CELLS, MASK = 1024, 64


def _scaled(polygons: DataFrame) -> DataFrame:
    """(poly_id, ring, n, _level, _cells): the cells of a polygon are 2 ** _level wide, some four times the root of its edges along a side."""
    lo = lambda c: F.array_min(F.transform("ring", lambda q: q[c]))
    hi = lambda c: F.array_max(F.transform("ring", lambda q: q[c]))
    n = F.size("ring") - 1
    side = F.greatest(hi("x") - lo("x"), hi("y") - lo("y"))
    cells = F.least(F.greatest(F.ceil(F.sqrt(n.cast("double"))) * 4.0, F.lit(16.0)), F.lit(float(CELLS)))
    level = F.ceil(F.log2(F.when(side > 0, side).otherwise(1.0) / cells)).cast("int")
    return polygons.select("poly_id", "ring", n.alias("n"), level.alias("_level"), cells.alias("_cells")).filter("n > 0")


def _cell_edges(scaled: DataFrame) -> DataFrame:
    """(poly_id, _level, cy, c0, c1, xc, edge): each edge in each row of cells it touches, the columns it touches there, and where
    it crosses the row's middle line."""
    e = scaled.select("poly_id", "_level", F.posexplode(F.slice("ring", 1, F.col("n"))).alias("seq", "p"), F.col("ring").alias("r"))
    q = F.element_at("r", F.col("seq") + 2)
    e = e.select("poly_id", "_level", F.pow(F.lit(2.0), F.col("_level")).alias("h"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    e = e.withColumn("pad", F.greatest(F.col("h") * 1e-6, F.lit(1e-9)))
    cell = lambda v: F.floor(v / F.col("h")).cast("long")
    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("cy", F.explode(F.sequence(cell(lo_y - F.col("pad")), cell(hi_y + F.col("pad")))))
    # the part of the edge in this row, a little longer
    at = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    ya = F.least(F.greatest(F.col("cy") * F.col("h") - F.col("pad"), lo_y), hi_y)
    yb = F.least(F.greatest((F.col("cy") + 1) * F.col("h") + F.col("pad"), lo_y), hi_y)
    xa, xb = at(ya), at(yb)
    left, right = F.coalesce(F.least(xa, xb), F.least("x1", "x2")), F.coalesce(F.greatest(xa, xb), F.greatest("x1", "x2"))
    mid = (F.col("cy") + 0.5) * F.col("h")
    crossed = F.when((F.col("y1") > mid) != (F.col("y2") > mid), at(mid))
    edge = F.struct("x1", "y1", "x2", "y2")
    return e.select("poly_id", "_level", "h", "cy", cell(left - F.col("pad")).alias("c0"), cell(right + F.col("pad")).alias("c1"), crossed.alias("xc"), edge.alias("edge"))


def polygon_cells(rows: DataFrame) -> DataFrame:
    """(poly_id, _level, cy, tx, inside, edge) from rows of _cell_edges: two masks over MASK columns of a row of cells.

    A cell that an edge touches has its bit in edge. A run of cells between two such cells is inside or outside as a whole, which
    the crossings of the row's middle line to its right decide.
    """
    g = rows.groupBy("poly_id", "_level", "h", "cy").agg(F.collect_list(F.sequence("c0", "c1")).alias("cs"), F.collect_list("xc").alias("xs"))
    g = g.withColumn("cs", F.array_sort(F.array_distinct(F.flatten("cs"))))
    runs = F.transform(F.sequence(F.lit(1), F.size("cs") - 1), lambda i: F.struct((F.element_at("cs", i) + 1).alias("a"), (F.element_at("cs", i + 1) - 1).alias("b")))
    runs = F.when(F.size("cs") > 1, F.filter(runs, lambda r: r["a"] <= r["b"])).otherwise(F.array().cast("array<struct<a:long,b:long>>"))
    runs = F.filter(runs, lambda r: F.size(F.filter("xs", lambda x: x > (r["a"] + 0.5) * F.col("h"))) % 2 == 1)
    inside = F.transform(runs, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.lit(True).alias("inside")))
    edge = F.transform("cs", lambda c: F.struct(c.alias("a"), c.alias("b"), F.lit(False).alias("inside")))
    t = g.select("poly_id", "_level", "cy", F.explode(F.concat(inside, edge)).alias("r")).select("poly_id", "_level", "cy", "r.*")
    t = t.withColumn("tx", F.explode(F.sequence(F.floor(F.col("a") / MASK), F.floor(F.col("b") / MASK))))
    lo, hi = F.greatest(F.col("a") - F.col("tx") * MASK, F.lit(0)).cast("int"), F.least(F.col("b") - F.col("tx") * MASK, F.lit(MASK - 1)).cast("int")
    bits = F.call_function("shiftleft", F.lit(-1).cast("long"), lo).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(MASK - 1) - hi))
    either = lambda flag: F.bit_or(F.when(F.col("inside") == flag, bits).otherwise(F.lit(0).cast("long")))
    return t.groupBy("poly_id", "_level", "cy", "tx").agg(either(True).alias("inside"), either(False).alias("edge"))


def points_in_polygon(points: DataFrame, polygons: DataFrame, point_id: str) -> DataFrame:
    """(point_id, poly_id) of the points inside or on each polygon.

    Each polygon has an index of cells that are inside, outside or touched by its edge, of a size that goes with its own. A point
    finds its cell by one equi-join for each size in use; only points in touched cells meet edges, those of their row of cells.
    The index is broadcast where its bounded size is small; else crowded cells are dealt to many owners. Points without a place
    are in nothing; a point that is repeated comes as often.
    """
    scaled = _scaled(polygons)
    # bounds on the index' rows and on the edges in its rows of cells
    rise = F.aggregate(F.zip_with(F.slice("ring", 1, F.col("n")), F.slice("ring", 2, F.col("n")), lambda a, b: F.abs(a["y"] - b["y"])), F.lit(0.0), lambda s, v: s + v)
    known = scaled.agg(F.collect_set("_level"), F.sum((F.col("_cells") + 2) * (F.col("_cells") / MASK + 2)), F.sum(rise / F.pow(F.lit(2.0), F.col("_level")) + F.col("n") * 3.0)).first()
    levels, n_index, n_edges = sorted(known[0]), int(known[1] or 0), int(known[2] or 0)
    tol = 2.220446049250313e-16**0.85
    rows = _cell_edges(scaled)
    index = polygon_cells(rows)
    edges = rows.select("poly_id", "cy", "edge.*")
    if n_index * 48 > SMALL or n_edges * 48 > SMALL:
        index, edges = cut_lineage(index, "cells"), cut_lineage(edges, "edges")
    p = points.select(F.col(point_id), "x", "y").withColumn("_level", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    p = p.withColumn("cy", cell("y")).withColumn("_cx", cell("x")).withColumn("tx", F.floor(F.col("_cx") / MASK))
    keys = ["_level", "cy", "tx"]
    j = p.join(F.broadcast(index), keys) if n_index * 48 <= SMALL else cut_lineage(balanced_join(p, index, keys), "met")
    bit = lambda c: F.call_function("shiftright", F.col(c), (F.col("_cx") - F.col("tx") * MASK).cast("int")).bitwiseAND(F.lit(1)) == 1
    inside = j.filter(bit("inside")).select(point_id, "poly_id")
    # a stated number of tasks: few points, but each meets many edges
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = j.filter(bit("edge")).select(point_id, "poly_id", "x", "y", "cy").repartition(tasks, point_id, "poly_id", "x", "y", "cy")
    met = met.groupBy(point_id, "poly_id", "x", "y", "cy").agg(F.count("*").alias("k"))
    # edges of the row that the point's height and the ray to its right can meet
    level_with = F.col("y").between(F.least("y1", "y2") - tol, F.greatest("y1", "y2") + tol) & (F.greatest("x1", "x2") >= F.col("x") - tol)
    met = met.join(F.broadcast(edges), ["poly_id", "cy"]).filter(level_with) if n_edges * 48 <= SMALL else balanced_join(met, edges, ["poly_id", "cy"], level_with)
    straddles = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
    met = met.withColumn("c", F.when(straddles & (F.col("x") < at), 1).otherwise(0)).withColumn("on", F.when(_on_edge(tol), 1).otherwise(0))
    hit = met.groupBy(point_id, "poly_id", "x", "y", "cy", "k").agg(F.sum("c").alias("c"), F.max("on").alias("on")).filter("c % 2 = 1 OR on = 1")
    return inside.unionByName(hit.select(point_id, "poly_id", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select(point_id, "poly_id"))


def near_boundary(points: DataFrame, polygons: DataFrame, point_id: str, radius: float) -> DataFrame:
    """(point_id, poly_id, boundary_m) of the points within a radius of a boundary.

    Edges are put into the cells that they can reach within the radius; points meet them there.
    """
    r = float(radius)
    cell = lambda c: F.floor(c / r).cast("long")
    reach = lambda lo, hi: F.explode(F.sequence(cell(F.least(lo, hi) - r), cell(F.greatest(lo, hi) + r)))
    e = edges_of(polygons).withColumn("_cx", reach("x1", "x2")).withColumn("_cy", reach("y1", "y2"))
    p = points.select(point_id, "x", "y").withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    d = dist2d(F.col("x"), F.col("y"), F.col("x1") + t * dx, F.col("y1") + t * dy)
    j = p.join(e, ["_cx", "_cy"]).withColumn("d", d).filter(F.col("d") <= r)
    return j.groupBy(point_id, "poly_id").agg(F.min("d").alias("boundary_m"))


def split_effective(towers: DataFrame, polygons: DataFrame, radius: float) -> DataFrame:
    """Towers with effective: inside or within the radius of the area."""
    hit = points_in_polygon(towers, polygons, "tower_id").select("tower_id")
    hit = hit.union(near_boundary(towers, polygons, "tower_id", radius).select("tower_id")).distinct()
    return towers.join(hit.withColumn("effective", F.lit(True)), "tower_id", "left").withColumn("effective", F.coalesce("effective", F.lit(False)))


def in_shrunk_area(points: DataFrame, polygons: DataFrame, point_id: str, by: float) -> DataFrame:
    """Points inside and at least `by` from the boundary."""
    inside = points_in_polygon(points, polygons, point_id)
    edge = near_boundary(points, polygons, point_id, by).filter(F.col("boundary_m") < by)
    return inside.join(edge, [point_id, "poly_id"], "left_anti")


def polygon_area_km2(polygons: DataFrame) -> DataFrame:
    e = edges_of(polygons)
    return e.groupBy("poly_id").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2e6).alias("area_km2"))


def polygon_centroid(polygons: DataFrame) -> DataFrame:
    e = edges_of(polygons).withColumn("k", F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    a = F.sum("k") * 3.0
    return e.groupBy("poly_id").agg((F.sum((F.col("x1") + F.col("x2")) * F.col("k")) / a).alias("cx"), (F.sum((F.col("y1") + F.col("y2")) * F.col("k")) / a).alias("cy"))


def area_membership(points: DataFrame, left: DataFrame, right: DataFrame, point_id: str, op: str) -> DataFrame:
    """Points in the union, intersection or difference of two sets of polygons."""
    a = points_in_polygon(points, left, point_id).select(point_id).distinct()
    b = points_in_polygon(points, right, point_id).select(point_id).distinct()
    if op == "union":
        return a.union(b).distinct()
    return a.intersect(b) if op == "intersect" else a.subtract(b)


def build_grid(polygons: DataFrame, n: int | None = None, res: float | None = None) -> DataFrame:
    """(poly_id, i, j, x, y): grid points in or on each polygon, by points on the longer side or by resolution.

    A scan line runs along each row of the grid: the edges it crosses, in order, begin and end the spans of the row that are inside,
    and edges that it touches add spans of their own. Only points of spans are made.
    """
    lo = lambda c: F.array_min(F.transform("ring", lambda q: q[c]))
    hi = lambda c: F.array_max(F.transform("ring", lambda q: q[c]))
    b = polygons.select("poly_id", "ring", lo("x").alias("lo_x"), hi("x").alias("hi_x"), lo("y").alias("lo_y"), hi("y").alias("hi_y"))
    w, h = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
    b = b.withColumn("res", F.lit(float(res)) if res else F.greatest(w, h) / (n - 1)).filter("res > 0")
    steps = lambda side: F.floor(side / F.col("res") + 1e-9).cast("int")
    b = b.withColumn("nx", steps(w)).withColumn("ny", steps(h))
    b = b.withColumn("x0", (F.col("lo_x") + F.col("hi_x")) / 2.0 - F.col("nx") / 2.0 * F.col("res")).withColumn("y0", (F.col("lo_y") + F.col("hi_y")) / 2.0 - F.col("ny") / 2.0 * F.col("res"))
    e = b.select("poly_id", "res", "nx", "ny", "x0", "y0", F.posexplode(F.slice("ring", 1, F.size("ring") - 1)).alias("seq", "p"), F.col("ring").alias("r"))
    q = F.element_at("r", F.col("seq") + 2)
    e = e.select("poly_id", "res", "nx", "ny", "x0", "y0", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    first = F.greatest(F.ceil((F.least("y1", "y2") - F.col("y0")) / F.col("res") - 1e-9), F.lit(0)).cast("int")
    last = F.least(F.floor((F.greatest("y1", "y2") - F.col("y0")) / F.col("res") + 1e-9), F.col("ny")).cast("int")
    e = e.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("j", F.explode(F.sequence("first", "last")))
    y = F.col("y0") + F.col("j") * F.col("res")
    flat = F.abs(F.col("y2") - F.col("y1")) <= F.col("res") * 1e-9
    t = F.least(F.greatest((y - F.col("y1")) / F.when(~flat, F.col("y2") - F.col("y1")), F.lit(0.0)), F.lit(1.0))
    at = F.col("x1") + t * (F.col("x2") - F.col("x1"))
    e = e.withColumn("cross", F.when(((F.col("y1") > y) != (F.col("y2") > y)) & ~flat, at))
    span = lambda a, c: F.struct(a.alias("a"), c.alias("b"))
    e = e.withColumn("touch", F.when(flat, span(F.least("x1", "x2"), F.greatest("x1", "x2"))).otherwise(span(at, at)))
    g = e.groupBy("poly_id", "res", "nx", "x0", "y0", "j").agg(F.array_sort(F.collect_list("cross")).alias("xs"), F.collect_list("touch").alias("touches"))
    pairs = F.transform(F.filter(F.transform("xs", lambda x, i: span(x, F.get("xs", i + 1))), lambda s: s["b"].isNotNull()), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), (i % 2 == 0).alias("inside")))
    inner = F.transform(F.filter(pairs, lambda s: s["inside"]), lambda s: span(s["a"], s["b"]))
    place = lambda v: (v - F.col("x0")) / F.col("res")
    cells = lambda s: F.struct(F.greatest(F.ceil(place(s["a"]) - 1e-9), F.lit(0)).cast("int").alias("a"), F.least(F.floor(place(s["b"]) + 1e-9), F.col("nx")).cast("int").alias("b"))
    own = F.filter(F.transform(F.concat(inner, "touches"), cells), lambda s: s["a"] <= s["b"])
    i = F.array_distinct(F.flatten(F.transform(own, lambda s: F.sequence(s["a"], s["b"]))))
    g = g.select("poly_id", F.explode(i).alias("i"), "j", "res", "x0", "y0")
    return g.select("poly_id", "i", "j", (F.col("x0") + F.col("i") * F.col("res")).alias("x"), (F.col("y0") + F.col("j") * F.col("res")).alias("y"))


def hull_of(x: list[float], y: list[float]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the lowest left."""
    pts = sorted(set(zip(x, y, strict=True)))
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for side in (pts, pts[::-1]):
        half: list[tuple[float, float]] = []
        for p in side:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def convex_hull(points: DataFrame, group: str) -> DataFrame:
    """(group, seq, x, y). Each task reduces its own points to their hull first; only hull corners are gathered."""
    schema = f"{group} {points.schema[group].dataType.simpleString()}, x double, y double"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, own in b.groupby(group):
                h = hull_of(own.x.tolist(), own.y.tolist())
                yield pd.DataFrame({group: [g] * len(h), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    def final(b: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(b.x.tolist(), b.y.tolist())
        return pd.DataFrame({group: [b[group].iloc[0]] * len(h), "seq": range(len(h)), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    part = points.select(group, F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(reduce, schema)
    return part.groupBy(group).applyInPandas(final, schema.replace(", x", ", seq long, x"))


def min_spacing(grid: DataFrame, part: float = 1e6) -> DataFrame:
    """The smallest gap among distinct x and among distinct y; found in ranges of `part`, each carrying its last value into the next."""
    out = None
    for c in ("x", "y"):
        d = grid.select(F.col(c).alias("v")).distinct().withColumn("_p", F.floor(F.col("v") / part))
        inner = d.withColumn("gap", F.col("v") - F.lag("v").over(W.partitionBy("_p").orderBy("v"))).groupBy("_p").agg(F.min("gap").alias("gap"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # one row for each range
        between = F.col("lo") - F.lag("hi").over(W.orderBy("_p"))
        gap = inner.select(F.least("gap", between).alias("gap")).agg(F.min("gap").alias("gap")).select(F.lit(c).alias("axis"), "gap")
        out = gap if out is None else out.unionByName(gap)
    return out


def axis_grid(axes: DataFrame) -> DataFrame:
    """Grid points of axes (axis, mean, n, res): n of them, `res` apart, centred on the mean."""
    g = axes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return g.select("axis", "i", ((F.col("i") - (F.col("n") - 1) / 2.0) * F.col("res") + F.col("mean")).alias("at"))
