"""Hard negatives: for an anchor and each of its positives, the best rows of other labels in a window under the positive's score.

1. Rows become blocks of integer vectors with their labels, ids and row numbers, written once; anchors are put into blocks of their
   own. Anchors come in stripes of at most STRIPE bytes, which are broadcast; every block of rows meets every block of anchors.
2. A pair of blocks is multiplied as a tile of 64-bit integers by Strassen's recursion: tiles are padded with zeros to even sides,
   seven products of half the side replace eight, and all additions are exact. Under CUT the product is plain, in doubles where
   the sums of products stay below 2 ** 53.
3. A task keeps a heap of the best rows of the same label for each anchor and gives it when its blocks are done; heaps are
   merged by rank. This settles the positives.
4. A second pass does the same with a heap for each (anchor, positive) over the rows of other labels whose score lies in the window.

A heap has K rows at most, so what is shuffled grows with anchors and tasks, not with pairs.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part; a row with a null id is no
anchor, keeps its label and sorts after all ids; rows that repeat an id are rows of their own, told apart by row number after
the id: an anchor's other rows include them, and repeated anchors give their rows once each; anchors without positives, and
positives without negatives in the window, give no rows; an empty table gives no rows; vectors of several lengths, or so large that
a score could leave 64 bits, are an error; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, stage
from .vectors import array_of, matrix, scaled, usable

SCALE, POSITIVES, NEGATIVES = 256.0, 5, 5
#: The window under a positive's score, in percent of it.
LOW, HIGH = 80, 100
#: Rows of a block, anchors of a block, bytes of anchors in a stripe.
BLOCK, ANCHORS, STRIPE = 4096, 1024, 16 << 20
#: Sides up to which tiles are multiplied plainly.
CUT = 32
_LEAST = np.iinfo(np.int64).min


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers. Sums wrap around in 64 bits, so that only the final scores must fit."""
    top = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0)))
    if top * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, cut: int = CUT) -> np.ndarray:
    """The product of two integer tiles."""
    if min(*a.shape, b.shape[1]) <= cut:
        return _plain(a, b)
    (n, k), m = a.shape, b.shape[1]
    if n % 2 or k % 2 or m % 2:
        return strassen(np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2))), cut)[:n, :m]
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = strassen(a11 + a22, b11 + b22, cut)
    p2 = strassen(a21 + a22, b11, cut)
    p3 = strassen(a11, b12 - b22, cut)
    p4 = strassen(a22, b21 - b11, cut)
    p5 = strassen(a11 + a12, b22, cut)
    p6 = strassen(a21 - a11, b11 + b12, cut)
    p7 = strassen(a12 - a22, b21 + b22, cut)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])


class Heaps:
    """The best k rows of each of n heaps: score descending, then id (null last), then row number. Mergeable by adding."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.heap = np.zeros(0, np.int64)
        self.entries = [np.zeros(0, np.int64) for _ in range(4)]  # score, id is null, id, row number

    @property
    def floor(self) -> np.ndarray:
        """The score under which a row cannot enter each heap."""
        out = np.full(self.n, _LEAST)
        full = np.bincount(self.heap, minlength=self.n) >= self.k
        last = np.r_[self.heap[1:] != self.heap[:-1], True] if len(self.heap) else np.zeros(0, bool)
        ends = self.heap[last]
        out[ends] = np.where(full[ends], self.entries[0][last], _LEAST)
        return out

    def add(self, heap: np.ndarray, *entries: np.ndarray) -> None:
        heap = np.concatenate([self.heap, heap])
        entries = [np.concatenate([a, b]) for a, b in zip(self.entries, entries, strict=True)]
        score, null, ids, number = entries
        order = np.lexsort((number, ids, null, -score, heap))
        heap = heap[order]
        first = np.flatnonzero(np.r_[True, heap[1:] != heap[:-1]]) if len(heap) else heap
        rank = np.arange(len(heap)) - np.repeat(first, np.diff(np.r_[first, len(heap)]))
        keep = rank < self.k
        self.heap, self.entries = heap[keep], [e[order][keep] for e in entries]


@dataclass
class Rows:
    """A block: vectors x, labels, ids (0 where null), null marks, row numbers."""

    x: np.ndarray
    label: np.ndarray
    null: np.ndarray
    ids: np.ndarray
    number: np.ndarray


def _offer(heaps: Heaps, at: np.ndarray, scores: np.ndarray, ok: np.ndarray, rows: Rows) -> None:
    """Rows with ok go to the heaps `at` (one for each line of scores)."""
    ok &= scores >= heaps.floor[at][:, None]
    if ok.sum() > 8 * heaps.k * len(at):  # many: only those that reach the k-th best score of their line
        own = np.where(ok, scores, _LEAST)
        k = min(heaps.k, own.shape[1])
        ok &= own >= np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k][:, None]
    line, col = np.nonzero(ok)
    heaps.add(at[line], scores[line, col], rows.null[col], rows.ids[col], rows.number[col])


_ROWS = "x binary, label binary, missing binary, ids binary, number binary, n int, width int"


def _pack(rows: Rows) -> list[pa.Array]:
    raw = [rows.x.astype(np.int32), rows.label, rows.null, rows.ids, rows.number]
    return [*(pa.array([r.tobytes()], pa.binary()) for r in raw), *(pa.array([v], pa.int32()) for v in rows.x.shape)]


def _unpack(batch: pa.RecordBatch, i: int, prefix: str = "") -> Rows:
    own = lambda c, kind: array_of(batch.column(prefix + c)[i], kind)
    n, width = (batch.column(prefix + c)[i].as_py() for c in ("n", "width"))
    return Rows(own("x", np.int32).reshape(n, width).astype(np.int64), *(own(c, np.int64) for c in ("label", "missing", "ids", "number")))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, label, v, number) in blocks of up to `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = [c.split()[0] for c in _ROWS.split(", ")] + ["meet"]

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, label, v, number = (t.column(c).combine_chunks() for c in ("vec_id", "label", "v", "number"))
            x = matrix(np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64), np.r_[0, v.value_lengths().to_numpy().cumsum()], 1 << 31)
            own = Rows(x, label.to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), number.to_numpy())
            return pa.RecordBatch.from_arrays([*_pack(own), pa.array([0], pa.int32())], names)

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if n + part.num_rows > size:
                    yield flush()
                    n = 0
                held.append(part)
                n += part.num_rows
        if n:
            yield flush()

    return rows.mapInArrow(run, f"{_ROWS}, meet int")


def _scores(a: Rows, b: Rows) -> np.ndarray:
    if a.x.shape[1] != b.x.shape[1]:
        raise ValueError(f"vectors of {a.x.shape[1]} and of {b.x.shape[1]} components")
    if int(np.abs(a.x).max(initial=0)) * int(np.abs(b.x).max(initial=0)) * max(1, a.x.shape[1]) >= 1 << 62:
        raise ValueError("scores do not fit into 64 bits")
    return strassen(a.x, np.ascontiguousarray(b.x.T))


def _pairs(blocks: DataFrame, stripe: DataFrame) -> DataFrame:
    """Every block of rows with every block of anchors of a stripe, whose size is bounded."""
    a = stripe.select([F.col(c).alias(c if c == "meet" else f"a_{c}") for c in stripe.columns])
    return blocks.join(F.broadcast(a), "meet")


_HEAP = "heap_no long, positive int, score long, missing long, id long, number long"


def _heaped(pairs: DataFrame, windows: bool) -> DataFrame:
    """Each task's heaps: of positives, or of the windows under the positives' scores (a_scores: k for each anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[Rows, Heaps, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                rows, own = _unpack(batch, i), batch.column("a_block")[i].as_py()
                if own not in kept:
                    a = _unpack(batch, i, "a_")
                    lines = len(a.number)
                    at = array_of(batch.column("a_scores")[i], np.int64).reshape(lines, -1) if windows else np.zeros((lines, 0), np.int64)
                    kept[own] = a, Heaps(lines * POSITIVES if windows else lines, NEGATIVES if windows else POSITIVES), at
                a, heaps, at = kept[own]
                scores = _scores(a, rows)
                same = a.label[:, None] == rows.label[None, :]
                if not windows:
                    _offer(heaps, np.arange(len(a.number)), scores, same & (a.number[:, None] != rows.number[None, :]), rows)
                    continue
                for k in range(POSITIVES):
                    # a missing positive has the least score, and no row lies in its window
                    top = at[:, k][:, None]
                    known = top > _LEAST
                    hundreds, rest = np.divmod(np.where(known, top, 0), 100)
                    low = LOW * hundreds - (-LOW * rest) // 100
                    high = HIGH * hundreds + HIGH * rest // 100
                    ok = ~same & known & (scores >= low) & (scores <= high)
                    _offer(heaps, np.arange(len(a.number)) * POSITIVES + k, scores, ok, rows)
        for a, heaps, _ in kept.values():
            anchor, positive = (heaps.heap // POSITIVES, heaps.heap % POSITIVES) if windows else (heaps.heap, np.zeros(len(heaps.heap), np.int64))
            cols = [a.number[anchor], positive.astype(np.int32), *heaps.entries]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in _HEAP.split(", ")])

    return pairs.mapInArrow(run, _HEAP)


def _merged(heaped: DataFrame, k: int) -> DataFrame:
    """The best k of each heap over all tasks, with their rank."""
    rank = F.row_number().over(W.partitionBy("heap_no", "positive").orderBy(F.desc("score"), "missing", "id", "number"))
    return heaped.withColumn("rank", rank).filter(F.col("rank") <= k)


def relabelled(vec_id: Column, label: Column) -> Column:
    """Rows whose id is divisible by 7 have the next of ten labels."""
    label = label.cast("long")
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    vec_id = F.col(id_col).cast("long")
    kept = rows.filter(F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    kept = kept.select(vec_id.alias("vec_id"), relabelled(vec_id, F.col(label_col)).alias("label"), scaled(F.col(vector_col), SCALE).alias("v"))
    blocks = stage(_blocks(kept.withColumn("number", F.monotonically_increasing_id()), BLOCK), "vector-rows")
    anchors = stage(_anchor_rows(blocks, every), "anchors")
    counted = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not counted[0]:
        return spark.createDataFrame([], _RESULT)
    row_bytes = 4 * counted[1] + 8 * (4 + POSITIVES)
    n_blocks = -(-counted[0] // ANCHORS)
    stripes = -(-counted[0] * row_bytes // STRIPE)
    # rows are dealt evenly, so every task has one block
    a_blocks = _blocks(anchors.repartition(n_blocks), 2 * ANCHORS).withColumn("block", F.monotonically_increasing_id())
    a_blocks = stage(a_blocks.withColumn("stripe", F.floor(F.spark_partition_id() * stripes / n_blocks)), "anchor-blocks")
    found = None
    for s in range(stripes):
        own = a_blocks.filter(F.col("stripe") == s)
        positives = stage(_merged(_heaped(_pairs(blocks, own), False), POSITIVES), "positives")
        wanted = _with_scores(own, positives)
        negatives = _merged(_heaped(_pairs(blocks, wanted), True), NEGATIVES)
        p = positives.select(F.col("heap_no").alias("p_heap"), (F.col("rank") - 1).alias("p_rank"), F.col("score").alias("positive_score"), _id("positive_id"))
        n = negatives.select("heap_no", "positive", "rank", F.col("score").alias("negative_score"), _id("negative_id"))
        part = n.join(p, (F.col("heap_no") == F.col("p_heap")) & (F.col("positive") == F.col("p_rank")))
        part = stage(part.join(anchors.select(F.col("number").alias("heap_no"), F.col("vec_id").alias("anchor_id")), "heap_no"), "hard-negatives")
        found = part if found is None else found.unionByName(part)
        release(positives)
    for t in (blocks, anchors, a_blocks):
        release(t)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _id(name: str) -> Column:
    return F.when(F.col("missing") == 0, F.col("id")).alias(name)


def _anchor_rows(blocks: DataFrame, every: int) -> DataFrame:
    """(vec_id, label, v, number) of the anchors in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = _unpack(batch, i)
                own = np.flatnonzero((r.null == 0) & (r.ids % every == 0))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * r.x.shape[1]), pa.array(r.x[own].ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(r.ids[own]), pa.array(r.label[own]), v, pa.array(r.number[own])], ["vec_id", "label", "v", "number"])

    return blocks.mapInArrow(run, "vec_id long, label long, v array<double>, number long")


def _with_scores(blocks: DataFrame, positives: DataFrame) -> DataFrame:
    """Anchor blocks with `scores`: each anchor's positive scores by rank, the least integer where one is missing."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = array_of(batch.column("number")[i], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column("block")[i].as_py())), pa.array(np.arange(len(n))), pa.array(n)], ["block", "line", "heap_no"])

    def line(t: pa.Table) -> pa.Table:
        scores = np.full((int(t.column("lines")[0].as_py()), POSITIVES), _LEAST)
        scores[t.column("line").to_numpy(), t.column("rank").to_numpy() - 1] = t.column("score").to_numpy()
        return pa.table([t.column("block").slice(0, 1), pa.array([scores.tobytes()], pa.binary())], ["block", "scores"])

    places = blocks.select("block", "number").mapInArrow(numbers, "block long, line long, heap_no long")
    j = places.join(positives.select("heap_no", "rank", "score"), "heap_no").join(blocks.select("block", F.col("n").alias("lines")), "block")
    scores = j.groupBy("block").applyInArrow(line, "block long, scores binary")
    return blocks.join(scores, "block")
