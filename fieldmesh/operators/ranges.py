"""Ordered operations over frozen ranges: ranks, running sums, carried values and neighbours without a window over a whole group.

`frozen` deals rows to ranges of their sort keys and writes them with the number of their range, so that every later look at the
ranges sees the same ones. An operation then works inside each (range, group) and gets from the ranges before it (or after it) what
one row for each (range, group) says: its count, its sum, its last value, its first row. Those few rows are the only ones that a
window sees across ranges. Ties of the sort keys are broken by a hash of the whole row, so equal keys may spread over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut_lineage

#: The number of a row's range, and what breaks ties.
PART, TIE = "_part", "_tie"


def frozen(df: DataFrame, keys: Sequence[Column], tag: str = "ranges") -> DataFrame:
    """df with PART and TIE, written: rows of a range have keys between those of the ranges before and after."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    part = df.withColumn(TIE, tie).repartitionByRange(*keys, F.col(TIE)).withColumn(PART, F.spark_partition_id())
    return cut_lineage(part, tag)


def _local(group: Sequence[str], keys: Sequence[Column]):
    return W.partitionBy(PART, *group).orderBy(*keys, TIE)


def _joined(df: DataFrame, parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """df with the columns of parts, of which there is one row for each range and group."""
    same = F.col("d." + PART) == F.col("p." + PART)
    for g in group:
        same &= F.col(f"d.`{g}`").eqNullSafe(F.col(f"p.`{g}`"))
    return df.alias("d").join(parts.alias("p"), same).select("d.*", *[F.col(f"p.`{c}`") for c in parts.columns if c not in (PART, *group)])


def ranked(df: DataFrame, keys: Sequence[Column], name: str, group: Sequence[str] = ()) -> DataFrame:
    """df with a rank from 1 on, in each group."""
    return running_sum(df, keys, F.lit(1).cast("long"), name, group)


def running_sum(df: DataFrame, keys: Sequence[Column], value: Column, name: str, group: Sequence[str] = ()) -> DataFrame:
    """df with the sum of value up to and with each row of its group, in the order of keys; keys begin with the group's columns."""
    part = frozen(df, keys).withColumn("_value", value)
    sums = part.groupBy(PART, *group).agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    run = F.sum("_value").over(_local(group, keys).rowsBetween(W.unboundedPreceding, 0))
    own = part.withColumn("_run", run)
    return _joined(own, sums, group).withColumn(name, F.col("_before") + F.col("_run")).drop("_before", "_run", "_value", PART, TIE)


def carried(df: DataFrame, keys: Sequence[Column], value: str, group: Sequence[str] = ()) -> DataFrame:
    """df whose value is the last one known up to each row of its group."""
    part = frozen(df, keys)
    w = _local(group, keys)
    known = F.col(value).isNotNull()
    # the last known value of each range and group: the one with the greatest place
    own = part.withColumn("_place", F.row_number().over(w)).withColumn("_last", F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = own.groupBy(PART, *group).agg(F.max_by(value, F.when(known, F.col("_place"))).alias("_end"))
    before = W.partitionBy(*group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return _joined(own, ends, group).withColumn(value, F.coalesce("_last", "_carry")).drop("_last", "_carry", "_place", PART, TIE)


def with_next(df: DataFrame, keys: Sequence[Column], columns: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """df with columns (new name -> column) of the next row of its group; null at its end."""
    part = frozen(df, keys)
    w = _local(group, keys)
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    own = part.withColumn("_next", F.lead(row).over(w)).withColumn("_place", F.row_number().over(w))
    firsts = own.groupBy(PART, *group).agg(F.min_by(row, "_place").alias("_first"))
    after = F.lead("_first").over(W.partitionBy(*group).orderBy(PART))
    firsts = firsts.withColumn("_after", after).drop("_first")
    out = _joined(own, firsts, group).withColumn("_next", F.coalesce("_next", "_after"))
    return out.withColumns({n: F.col(f"_next.{n}") for n in columns}).drop("_next", "_after", "_place", PART, TIE)
