"""Mixing sources to target weights by capped water-filling, in DataFrame functions.

Sources that would exceed `max_epochs` times their size are clamped there; what they leave is shared among the
others in proportion to their weights, until none is above its cap. The fixpoint is found at once: sources in
the order of cap / weight are clamped up to the first whose share stays within its cap.

A target of r times the source's size is taken as floor(r) whole repetitions of every document and a fractional
one: documents in a seeded hash order until the remaining words are met. The order is cut in two steps,
so that no source is sorted as a whole: running sums over BUCKETS hash buckets find the bucket in which the cut
falls, and only that bucket's documents are ordered.

Defined cases: null text has size 0; null source is a source of its own, last in order; sources of size 0
have target 0; an empty table gives no rows; rows that repeat a doc_id are taken one by one; hash ties are broken
by doc_id; clashing extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, sized, stage, text_or_empty

WEIGHTS = (5, 2, 1)
#: Hash buckets of a source's order.
BUCKETS = 4096


def sizes(docs: DataFrame, *more: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words) of every row, with further columns."""
    n = F.size(F.split(F.trim(F.regexp_replace(text_col, SPACE, " ")), " "))
    size = F.when(text_or_empty(text_col).rlike(WORD), n).otherwise(0).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *more)


def targets(by_source: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    every = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = W.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    below, all_ = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    s = s.withColumn("cap_below", F.coalesce(F.sum("cap").over(below), F.lit(0)))
    s = s.withColumn("w_rest", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(below), F.lit(0)))
    s = s.withColumn("total", F.sum("source_size").over(all_))
    # the level if all sources before this one are clamped; the first that stays within its cap sets it
    s = s.withColumn("level", (F.col("total") * share - F.col("cap_below")) / F.col("w_rest"))
    s = s.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("water", F.min(F.when(F.col("free"), F.struct(F.col("cap_below"), F.col("level")))).over(all_)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("w")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _dealt(d: DataFrame, seed: int, share: float, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """Rows of `sizes` with source_size, target and repeats."""
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("rank", rank).withColumn("bucket", F.conv(F.substring("rank", 1, 3), 16, 10).cast("int"))
    by_bucket = stage(d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    by_bucket = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, max_epochs, weights)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = by_bucket.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    plan = plan.select("b.source", "bucket", "before", "bucket_size", "source_size", "target", "whole", "rest")
    state = F.when(F.col("before") + F.col("bucket_size") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    plan = stage(plan.withColumn("state", state), "mix-plan")
    # BUCKETS rows a source at most
    small_side = sized(plan, plan.count(), 128)
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))
    j = d.alias("d").join(small_side.alias("p"), same).select("d.*", "before", "source_size", "target", "whole", "rest", "state")
    settled = j.filter("state < 2").withColumn("extra", F.col("state"))
    run = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    cut = j.filter("state = 2").withColumn("upto", F.col("before") + F.sum("size").over(run))
    # the document at the cut goes in if that leaves the source nearer to its target
    cut = cut.withColumn("extra", F.when(F.col("upto") - F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0)).drop("upto")
    return settled.unionByName(cut).withColumn("repeats", F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs)).cast("int"))


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats for every row of documents."""
    out = _dealt(sizes(docs), seed, share, max_epochs, weights)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats")


def mixed(docs: DataFrame, seed: int = 17, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with its own columns; rows are not joined by id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _dealt(sizes(docs, row), seed, share, max_epochs, weights).filter("repeats > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("again")).select("row.*")
