"""Connected components of an edge table, by smallest label."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


class Forest:
    """Union-find over arbitrary keys; the smallest key is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars around the smallest ids of its own components: fewer edges, shorter paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.join(x, y)
        ids = list(forest.up)
        roots = [forest.find(x) for x in ids]
        keep = [i for i, (x, r) in enumerate(zip(ids, roots, strict=True)) if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([roots[i] for i in keep], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in an edge (a, b); component is the smallest id reachable.

    Every round takes the smallest label among the neighbours and then that label's own label, so the number
    of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder.
    """
    e = stage(_contract(edges).distinct(), "stars")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = stage(new.join(jump, "label", "left").select("id", F.least("label", "far").alias("label"), "old"), "labels")
        changed = new.filter("label != old").limit(1).count()
        release(labels)
        labels = new.select("id", "label")
        labels._staged_path = new._staged_path
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
