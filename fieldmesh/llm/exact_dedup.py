"""Exact deduplication through an extendible-hash index on shared files, in DataFrame functions only.

1. Every row's normalised text gets a 64-bit key; the entries go to the shared folder. A key with more than capacity / SHARE entries is
   cut into slices of about that many; a row's slice is a hash of its doc_id.
2. The directory: entries are counted in cells of their keys' first STEP_BITS bits (a sliced key counts as one slice), and
   directory doubling takes for each cell the smallest depth at which its bucket holds at most `capacity` entries. Cells that are
   overfull at that depth are doubled on by the next STEP_BITS bits, until all buckets fit or the key's 64 bits are used up.
3. Keys that several entries have get chains: their texts are fetched and grouped by (bucket, key, text), which compares
   bytes, and every distinct text of a key becomes one entry of the key's chain. The grouping is partial before the shuffle, so a
   hot group arrives as one row from each task.
4. Owners: a bucket is a range of keys, and the task that owns a slice of it gets the bucket's entries and chain entries, sorts
   them by key and links each entry with its key's chain. Slices of a key are about equal and one of them counts in the bucket, so no owner
   gets more than about `capacity` entries of a bucket, however hot a key is. What owners find is the index that is written.
5. Index entries of a key with one chain entry are done: all bytes behind that key are equal. Where keys collide, the rows are
   linked with the chain entry whose text theirs is, byte by byte.

Defined cases: null text counts as empty; empty texts equal one another; ties cannot occur between distinct
doc_ids, and rows that repeat a doc_id are all returned and all marked alike; an empty table gives no rows; columns other
than the two named are ignored, whatever their names; a null doc_id sorts after all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, release, rows_of, sized, stage

STEP_BITS = 8
#: A key is sliced where it alone has more than one part in SHARE of a bucket's capacity.
SHARE = 4


def normalised(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " ")


def _doubled(cells: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(parent, cell, slices, depth, load): every doubling of each parent's directory at once, and the first depth that fits."""
    levels = cells.select("parent", "cell", "n", "slices", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    load = levels.groupBy("parent", "depth", prefix.alias("prefix")).agg(F.sum("n").alias("load"))
    fits = load.filter((F.col("load") <= capacity) | (F.col("depth") == bits))
    found = levels.select("parent", "cell", "slices", "depth", prefix.alias("prefix")).join(fits, ["parent", "depth", "prefix"])
    best = found.groupBy("parent", "cell").agg(F.min(F.struct("depth", "load")).alias("best"), F.max("slices").alias("slices"))
    return best.select("parent", "cell", "slices", "best.depth", "best.load")


def directory(keys: DataFrame, capacity: int, bits: int = STEP_BITS) -> list[DataFrame]:
    """One table for each step of `bits` bits: (parent, cell, low, over, slices). A bucket's name is its lowest key, unsigned.

    keys: key, and, where a key stands for more than one entry in one slice, load (entries of a slice) and slices.
    parent is the bits of all steps before (0 in the first); only cells that were overfull there go on.
    """
    steps: list[DataFrame] = []
    todo = keys if "load" in keys.columns else keys.select("key", F.lit(1).alias("load"), F.lit(1).alias("slices"))
    for done in range(0, 64, bits):
        parent = F.shiftrightunsigned("key", 64 - done) if done else F.lit(0).cast("long")
        cell = F.shiftrightunsigned(F.shiftleft("key", done), 64 - bits)
        cells = todo.groupBy(parent.alias("parent"), cell.alias("cell")).agg(F.sum("load").alias("n"), F.max("slices").alias("slices"))
        # the lowest key: the parent's bits, the bucket's prefix, zeros
        prefix = F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)")
        low = F.shiftleft(F.shiftleft("parent", bits).bitwiseOR(prefix), 64 - done - bits)
        step = stage(_doubled(cells, capacity, bits).select("parent", "cell", low.alias("low"), (F.col("load") > capacity).alias("over"), "slices"), "directory")
        steps.append(step)
        over = step.filter("over")
        n_over = over.count()
        if not n_over or done + bits >= 64:
            break
        full = over.select(F.shiftleft("parent", bits).bitwiseOR(F.col("cell")).alias("full"))
        todo = todo.join(sized(full, n_over, 16), F.shiftrightunsigned("key", 64 - done - bits) == F.col("full"), "left_semi")
    return steps


def with_bucket(entries: DataFrame, steps: list[DataFrame], bits: int = STEP_BITS) -> DataFrame:
    """The entries with the bucket that the directory names for their key; entries may have a slice, which spreads hot cells."""
    out = entries.withColumn("bucket", F.lit(None).cast("long"))
    for i, step in enumerate(steps):
        done = i * bits
        parent = F.shiftrightunsigned("key", 64 - done) if done else F.lit(0).cast("long")
        cell = F.shiftrightunsigned(F.shiftleft("key", done), 64 - bits)
        s = step.select(F.col("parent").alias("p"), F.col("cell").alias("c"), "low", *([_slices().alias("s")] if "slice" in entries.columns else []))
        same = (parent == F.col("p")) & (cell == F.col("c"))
        if "slice" in entries.columns:
            same = same & (F.col("slice") == F.col("s"))
        out = out.join(sized(s, s.count(), 48), same, "left").withColumn("bucket", F.coalesce("low", "bucket")).drop("p", "c", "low", "s")
    return out


def _slices() -> Column:
    """One row for each slice."""
    return F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))


def _sliced(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows with their key's slice; heavy: key, slices, at most one for each capacity / SHARE rows."""
    h = sized(heavy, heavy.count(), 24)
    return rows.join(h, "key", "left").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 16384,
    key: Callable[[Column], Column] = F.xxhash64,
    bits: int = STEP_BITS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    entries = stage(base.select("doc_id", key(F.col("norm")).alias("key"), F.sha2("norm", 256).alias("text_sha256")), "hash-entries")
    slices = F.ceil(F.col("n") / F.lit(max(capacity // SHARE, 1))).cast("int")
    keys = entries.groupBy("key").agg(F.count("*").alias("n")).withColumn("slices", slices)
    keys = stage(keys.withColumn("load", F.ceil(F.col("n") / F.col("slices"))), "hash-keys")
    heavy = keys.filter("slices > 1").select("key", "slices")
    steps = directory(keys, capacity, bits)
    multi = keys.filter("n > 1").select("key", _slices().alias("slice"))
    multi = stage(with_bucket(multi, steps, bits), "hash-chains")
    members = _sliced(base.withColumn("key", key(F.col("norm"))), heavy).join(sized(multi, multi.count(), 64), ["key", "slice"])
    chain = stage(members.groupBy("bucket", "key", "norm").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")), "chain-entries")
    collided = chain.groupBy("bucket", "key").agg(F.count("*").alias("entries")).filter("entries > 1").select("bucket", "key")
    collided = stage(collided, "collided-keys")
    n_collided = collided.count()

    everywhere = chain.join(sized(heavy, heavy.count(), 24), "key", "left").withColumn("slice", _slices())
    own = with_bucket(_sliced(entries, heavy), steps, bits).withColumn("link", F.lit(0))
    met = own.unionByName(everywhere.select("bucket", "key", "slice", "first_id", "size", F.lit(1).alias("link")), allowMissingColumns=True)
    # the partitioning by owner serves the window: nothing is shuffled again
    chains = W.partitionBy("bucket", "slice", "key")
    found = [F.max(c).over(chains).alias(c) for c in ("first_id", "size")]
    index = met.repartition(parts, "bucket", "slice").select("bucket", "slice", "key", "doc_id", "text_sha256", "link", *found, F.sum("link").over(chains).alias("chained"))
    index = stage(index.filter("link = 0").drop("link"), "hash-index")
    columns = ["doc_id", "text_sha256", "first_id", "size"]
    out = index.filter("chained <= 1").select(columns)
    if n_collided:
        apart = sized(collided, n_collided, 64)
        texts = everywhere.join(apart, ["bucket", "key"], "left_semi")
        rows = members.join(apart, ["bucket", "key"], "left_semi").join(texts, ["bucket", "key", "slice", "norm"])
        out = out.unionByName(rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "first_id", "size"))
    for t in (entries, *steps, *([] if n_collided else (keys, multi, chain, collided))):
        release(t)
    keep = F.coalesce("first_id", "doc_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns; of rows that repeat a doc_id (or have none) and a text one stays."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256")
    return rows_of(docs, kept, doc_id=F.col(f"d.`{id_col}`"), text_sha256=F.sha2(normalised(F.col(f"d.`{text_col}`")), 256))
