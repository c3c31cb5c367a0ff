"""What the operators share: scratch tables, size-checked broadcasts and word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmesh.operators.scratch import cut_lineage as stage
from fieldmesh.operators.scratch import drop_path, scratch_path, shared_dir

__all__ = ["documents", "drop_path", "release", "rows_of", "scratch_path", "shared_dir", "sized", "small", "stage", "text_or_empty"]

#: Small sides up to this many bytes (rows counted, times a stated row size) are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 48 << 20
#: Words are runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (a string or binary column) have about `limit` bytes; longer texts stand alone."""
    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def release(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_path", None)
    if path:
        drop_path(df.sparkSession, path)


def rows_of(docs: DataFrame, kept: DataFrame, **keys: Column) -> DataFrame:
    """The rows of `docs` whose keys (columns over docs, by name) are among `kept`, with their own columns.

    kept may name a key several times; of the rows that share all keys one stays (the one whose columns' hash is smallest).
    """
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    own = docs.alias("d").select(F.struct(*cols).alias("row"), *(c.alias(k) for k, c in keys.items()))
    wanted = kept.groupBy(*keys).agg(F.count("*").alias("n")).select(*(F.col(k).alias(f"w_{k}") for k in keys), "n")
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]
    got = own.join(wanted, same)
    if not wanted.filter("n > 1").limit(1).count():
        return got.select("row.*")
    one = got.filter("n > 1").groupBy(*keys).agg(F.min_by("row", F.xxhash64("row.*")).alias("row"))
    return got.filter("n = 1").select("row.*").union(one.select("row.*"))


def sized(small: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark the small side for broadcast only if its counted size is within BROADCAST_BYTES."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
