"""Links between transmitters and receivers: profiles, blockage and per-link corrections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmesh.functions import radio

from . import ragged

#: Towers of one site, about, at most; links that a task has to sort, at most about.
MEMBERS, SORTED = 65536, 1 << 22
HEIGHTS = (1.5, 3.0, 5.0, 7.5, 10.0, 50.0, 100.0, 125.0)


def site_links(towers: DataFrame, rx: DataFrame, radius: float, by: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): the links of every site, and the sites (site, tower_ids of its towers and the towers' columns).

    A site is what towers (tower_id, x, y and more) with equal columns share, so that a link's values are computed once for all of
    them. links has rx's rx_id, x, y, dist_m and the site's columns with tx_ before their names. A crowded site is several.
    by, most: as range_join takes them.
    """
    from .scratch import cut_lineage
    from .spatial import range_join

    own = [c for c in towers.columns if c != "tower_id"]
    parts = towers.count() // MEMBERS + 1
    g = towers.groupBy(*own, F.pmod(F.xxhash64("tower_id"), F.lit(parts)).alias("_p")).agg(F.collect_list(F.col("tower_id")).alias("tower_ids"))
    # numbers are written, so that both tables have the same
    g = cut_lineage(g.drop("_p").withColumn("site", F.monotonically_increasing_id()), "sites")
    j = range_join(rx.select("rx_id", "x", "y"), g.select("site", *own), radius, by=by, most=most)
    return j.select("rx_id", F.col("b_site").alias("site"), "x", "y", *[F.col(f"b_{c}").alias(f"tx_{c}") for c in own], "dist_m"), g


def by_site(links: DataFrame, site: str = "site") -> DataFrame:
    """Each task's links site by site: what is written repeats itself then, as a site's towers do, and takes little space."""
    # the optimizer drops an order that is below a join, but does not look through a generator
    return links.sortWithinPartitions(site).withColumn("_once", F.explode(F.array(F.lit(0)))).drop("_once")


def each_tower(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links of sites (site, ...) as links of their towers: tower_id in the place of site."""
    from .spatial import sized

    size = members.agg(F.sum(F.size("tower_ids") + 4)).first()[0] or 0
    j = links.join(sized(members.select("site", "tower_ids"), size, 8), "site").withColumn("tower_id", F.explode("tower_ids"))
    return j.select(*["tower_id" if c == "site" else c for c in links.columns])


def link_join(towers: DataFrame, rx: DataFrame, radius: float) -> DataFrame:
    j = each_tower(*site_links(towers.select("tower_id", "x", "y", "height_m"), rx, radius))
    return j.select("rx_id", "tower_id", "x", "y", "tx_x", "tx_y", "tx_height_m", "dist_m")


def with_heights(links: DataFrame, heights: tuple[float, ...] = HEIGHTS) -> DataFrame:
    """Every link for every receiver height; what hangs on the link is not computed again."""
    return links.withColumn("rx_height_m", F.explode(F.array(*[F.lit(h) for h in heights])))


def sample_profile(links: DataFrame, res: float, min_n: int = 10) -> DataFrame:
    """Adds samples: n = max(ceil(D / res), min_n) places from transmitter to receiver, both ends included."""
    n = F.greatest(F.ceil(F.col("dist_m") / res), F.lit(min_n)).cast("int")
    t = lambda i: i / (F.col("n_samples") - 1.0)
    place = lambda i: F.struct((F.col("tx_x") + (F.col("x") - F.col("tx_x")) * t(i)).alias("x"), (F.col("tx_y") + (F.col("y") - F.col("tx_y")) * t(i)).alias("y"))
    return links.withColumn("n_samples", n).withColumn("samples", F.transform(F.sequence(F.lit(0), F.col("n_samples") - 1), place))


def profile_struct(profile: Column, dist: Column) -> Column:
    """(n, step_m, z): intervals, their length, the heights."""
    n = F.size(profile) - 1
    return F.struct(n.alias("n"), (dist / n).alias("step_m"), profile.alias("z"))


def fill_profile(profile: Column) -> Column:
    """Missing heights become the profile's lowest."""
    low = F.array_min(F.filter(profile, lambda z: z.isNotNull()))
    return F.transform(profile, lambda z: F.coalesce(z, low))


def _sums(profile: pa.Array) -> pa.Array:
    p = ragged.Lists(profile)
    lost = p.null if p.unknown is None else p.null | (ragged.by_row(np.add, p.unknown.astype(np.int64), p.n, 0) > 0)
    return pa.array(ragged.running_sum(p.z, p.n), mask=lost)


def sum_heights(profile: Column) -> Column:
    """The sum of a profile's heights, added up from its first to its last; null where one is missing."""
    return _SUM_HEIGHTS(profile)


def orient_link(df: DataFrame) -> DataFrame:
    """The higher end by altitude (tx_alt_m, rx_alt_m) becomes the transmitter; profiles turn with it. Unknown: as it is."""
    swap = F.col("rx_alt_m") > F.col("tx_alt_m")
    one = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return df.select(
        *[F.col(c) for c in df.columns if c not in ("tx_alt_m", "rx_alt_m", "profile")],
        one("rx_alt_m", "tx_alt_m").alias("tx_alt_m"), one("tx_alt_m", "rx_alt_m").alias("rx_alt_m"),
        F.when(swap, F.reverse("profile")).otherwise(F.col("profile")).alias("profile"), swap.alias("swapped"),
    )


#: What judges samples: from z, d, tx, rx, dist, the distance to the line, and each one's row, whether it blocks.
Judge = Callable[..., np.ndarray]


def _flags(judge: Judge) -> Callable[..., pa.Array]:
    """Whether each sample but the two ends blocks: at or above the line, or by what `judge` says of those below; null where unknown."""

    def run(profile: pa.Array, dist: pa.Array, tx: pa.Array, rx: pa.Array, wavelength: pa.Array, ratio: pa.Array) -> pa.Array:
        p = ragged.Lists(profile)
        dist, tx, rx, wavelength, ratio = (ragged.doubles(c) for c in (dist, tx, rx, wavelength, ratio))
        m, start = np.maximum(p.n - 2, 0), np.cumsum(p.n) - p.n
        with np.errstate(all="ignore"):
            step, full = dist / (p.n - 1.0), np.sqrt((0.0 - dist) * (0.0 - dist) + (tx - rx) * (tx - rx))
            flags, unknown = np.empty(m.sum(), bool), np.zeros(m.sum(), bool)
            for lo, hi, a, b in ragged.passes(m):
                k, i = m[lo:hi], ragged.places(m[lo:hi])
                each = lambda v: np.repeat(v[lo:hi], k)  # noqa: B023, E731
                at = each(start) + i + 1
                z, d, far, low = p.z[at], (i + 1) * each(step), each(dist), each(tx)
                line = d / far * each(rx - tx) + low
                off = np.abs(far * (z - low) - each(rx - tx) * d) / each(full)
                flag, lost = z >= line, np.isnan(off)
                below = np.flatnonzero(z < line)
                row = np.repeat(np.arange(lo, hi), k)[below]
                flag[below], unsure = judge(z[below], d[below], off[below], row, tx, rx, dist, full, wavelength, ratio)
                lost[below] |= unsure
                if lost.any():
                    # a height that is not a number, but not missing, is above any line
                    odd = lost & np.isnan(z) & ~np.isnan(line)
                    odd &= ~p.unknown[at] if p.unknown is not None else True
                    flag |= odd
                    lost &= ~odd
                flags[a:b], unknown[a:b] = flag, lost
        return ragged.lists(m, pa.array(flags, mask=unknown), p.null)

    return run


def _radius(w: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return np.sqrt(w * d1 * d2 / (d1 + d2))


def _by_first_zone(z, d, off, row, tx, rx, dist, full, wavelength, ratio) -> tuple[np.ndarray, np.ndarray]:
    """Cheap tests first: few samples are nearer to the line than the widest radius."""
    widest = _radius(wavelength, full / 2.0, full / 2.0) * ratio
    flag, lost = np.zeros(len(z), bool), np.isnan(widest)[row]
    near = np.flatnonzero(~(off >= widest[row]))
    z, d, off, row = z[near], d[near], off[near], row[near]
    d1 = np.sqrt(np.maximum(d * d + (z - tx[row]) * (z - tx[row]) - off * off, 0.0))
    d2 = dist[row] - d1  # the planar length, although d1 runs along the line
    flag[near] = ~(d2 < 0) & (off < _radius(wavelength[row], d1, d2) * ratio[row])
    return flag, lost


def _by_straight_distances(z, d, off, row, tx, rx, dist, full, wavelength, ratio) -> tuple[np.ndarray, np.ndarray]:
    up, down, rest = z - tx[row], z - rx[row], dist[row] - d
    most = _radius(wavelength[row], np.sqrt(d * d + up * up), np.sqrt(rest * rest + down * down)) * ratio[row]
    return off <= most, np.isnan(most)


def _blocked_share(flags: pa.Array) -> pa.Array:
    n = flags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = flags.flatten()
    known = ~flat.is_null().to_numpy(zero_copy_only=False)
    blocked = flat.fill_null(False).to_numpy(zero_copy_only=False)
    some = ragged.by_row(np.add, known.astype(np.int64), n, 0) > 0
    return pa.array(ragged.by_row(np.add, blocked.astype(np.int64), n, 0) / np.maximum(n, 1), mask=~some)


_FLAGS, _DOUBLE = T.ArrayType(T.BooleanType()), T.DoubleType()
_CLASSIFY = F.arrow_udf(_flags(_by_first_zone), _FLAGS)
_APPROXIMATE = F.arrow_udf(_flags(_by_straight_distances), _FLAGS)
_SHARE, _SUM_HEIGHTS = F.arrow_udf(_blocked_share, _DOUBLE), F.arrow_udf(_sums, _DOUBLE)


def classify_samples(profile: Column, dist: Column, tx: Column, rx: Column, wavelength: Column, ratio: float = 0.6) -> Column:
    """Whether each inner sample blocks the first Fresnel zone."""
    return _CLASSIFY(profile, dist, tx, rx, wavelength, F.lit(float(ratio)))


def approximate_samples(profile: Column, dist: Column, tx: Column, rx: Column, wavelength: Column, ratio: float = 0.6) -> Column:
    """The same with the straight distances from both ends to the sample."""
    return _APPROXIMATE(profile, dist, tx, rx, wavelength, F.lit(float(ratio)))


def blockage(flags: Column, dist: Column, tx: Column, rx: Column, wavelength: Column) -> tuple[Column, Column]:
    """(blocked distance, free-space loss where nothing blocks, else null); both null where no sample is known."""
    share = _SHARE(flags)
    full = F.sqrt(dist * dist + (tx - rx) * (tx - rx))
    return dist * share, F.when(share == 0, radio.fspl_db(full, wavelength))


def blockage_strict(profile: Column, dist: Column, tx: Column, rx: Column, wavelength: Column, ratio: float = 0.6) -> Column:
    """Loss where all samples are clear, without a distance."""
    return blockage(approximate_samples(profile, dist, tx, rx, wavelength, ratio), dist, tx, rx, wavelength)[1]


def blockage_half(profile: Column, dist: Column, tx: Column, rx: Column, wavelength: Column, ratio: float = 0.6) -> Column:
    """Loss where the line passes over all samples with (ratio - 1/2) * 2 of the first radius to spare."""
    return blockage_strict(profile, dist, tx, rx, wavelength, (ratio - 0.5) * 2.0)


def with_vegetation(df: DataFrame, f: Column) -> DataFrame:
    """From blockage_dist_m, terrain_dist_m and coverage_db: vegetation depth, loss with vegetation."""
    depth = radio.within(F.col("blockage_dist_m") - F.col("terrain_dist_m"), 0.0)
    return df.withColumn("veg_dist_m", depth).withColumn("loss_with_veg_db", F.col("coverage_db") + radio.woodland_excess_db(f, depth))
