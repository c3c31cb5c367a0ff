"""Vector codes: each of PARTS parts of a vector by the nearest entry of its codebook, learnt by dual-tree Lloyd.

1. Rows become blocks of up to BLOCK integer vectors, written once. For each part a block has a tree: points halve at the median
   of the widest component down to leaves of about LEAF points; every leaf keeps its box and its sums, and the boxes and sums
   of the nodes above fold up from them. Trees over the parts stay the same in all rounds.
2. A round carries the codebooks to the tasks, each with a tree over its entries. Pairs of nodes descend together. A pair goes
   when the entries' node is farther from all of the points' box than another node is at most; single entries go when another
   one is nearer to every corner of the box. A node of points with one entry left is assigned whole, by its cached sums. Points of
   leaves with several entries left compare exact integer distances.
3. Tasks give count and sums of each (part, entry); these are added up, and the driver replaces the entries, of which there are
   PARTS * ENTRIES at most.

All bounds and distances are integers, so codes, errors and codebooks are the same however the rows are dealt. Doubles hold them
while they stay below 2 ** 53, 64-bit integers beyond.

Defined cases: rows whose vector is null or has null or non-finite components are dropped; a null id sorts last, and rows that
repeat an id are all coded, ordered among each other by their integers where entries start; fewer than ENTRIES rows make a
smaller codebook; null labels are one group; an empty table gives no rows; vectors of several lengths, of a length that PARTS does
not divide, or with components of 2 ** 28 or more after scaling are an error; vectors without components have code 00 in each part
and error 0; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sized, stage
from .vectors import array_of, matrix, scaled, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Points of a block and of a leaf, about.
BLOCK, LEAF = 4096, 64
#: Copies of a label's sum where labels are too many to be broadcast.
SALT = 16
_LIMIT = 1 << 28


def _levels(n: int, leaf: int) -> int:
    """Halvings until a leaf has about `leaf` of n points."""
    return max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0


def _borders(n: int, levels: int) -> np.ndarray:
    """Where the leaves begin and end when n points are halved so often."""
    cut = np.array([0, n])
    for _ in range(levels):
        cut = np.sort(np.concatenate([cut, (cut[:-1] + cut[1:]) // 2]))
    return cut


def _order(x: np.ndarray, levels: int) -> np.ndarray:
    """The points in the order of the leaves: every node is halved at the median of its widest component."""
    order, cut = np.arange(len(x)), np.array([0, len(x)])
    for _ in range(levels if x.shape[1] else 0):
        mid = (cut[:-1] + cut[1:]) // 2
        for lo, m, hi in zip(cut[:-1], mid, cut[1:], strict=True):
            own = x[order[lo:hi]]
            widest = int(np.argmax(own.max(0) - own.min(0)))
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, widest], m - lo)]
        cut = np.sort(np.concatenate([cut, mid]))
    return order


@dataclass
class Nodes:
    """A tree whose leaves are equally deep: boxes of each level, the root first. Node i has children 2 i and 2 i + 1."""

    lo: list[np.ndarray]
    hi: list[np.ndarray]

    @classmethod
    def over(cls, lo: np.ndarray, hi: np.ndarray) -> Nodes:
        los, his = [lo], [hi]
        while len(los[0]) > 1:
            los.insert(0, np.minimum(los[0][0::2], los[0][1::2]))
            his.insert(0, np.maximum(his[0][0::2], his[0][1::2]))
        return cls(los, his)


class Codebook:
    """The entries of a part and a tree over them. Missing entries of the last level repeat the last one and are never used."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        levels = int(np.ceil(np.log2(max(1, len(entries)))))
        full = np.concatenate([entries, np.repeat(entries[-1:], (1 << levels) - len(entries), 0)])
        self.leaf = np.minimum(_order(full, levels), len(entries) - 1)
        own = self.entries[self.leaf]
        self.nodes = Nodes.over(own, own)


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _gaps(pl: np.ndarray, ph: np.ndarray, el: np.ndarray, eh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between two boxes."""
    over, under = pl - eh, el - ph
    most = np.maximum(-over, -under)
    least = np.maximum(np.maximum(over, under, out=over), 0, out=over)
    return _squares(least), _squares(most)


def _groups(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return first, np.diff(np.r_[first, len(p)])


def candidates(points: Nodes, book: Codebook) -> tuple[list[tuple[int, int, int]], dict[int, np.ndarray]]:
    """Nodes (level, node, entry) assigned whole, and the entries left of every other leaf of points, ascending."""
    whole: list[tuple[int, int, int]] = []
    depth, e_depth = len(points.lo) - 1, len(book.nodes.lo) - 1
    # pairs, in the order of the points' nodes
    p, e, pd, ed = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    if not e_depth:
        e = book.leaf[e]
    while True:
        # at the last level pairs name entries by their own numbers
        el, eh = (book.entries, book.entries) if ed == e_depth else (book.nodes.lo[ed], book.nodes.hi[ed])
        least, most = _gaps(points.lo[pd][p], points.hi[pd][p], el[e], eh[e])
        first, size = _groups(p)
        keep = least <= np.repeat(np.minimum.reduceat(most, first), size)
        p, e = p[keep], e[keep]
        if ed == e_depth:
            p, e = _dominated(points, pd, p, e, book)
            first, size = _groups(p)
            whole += [(pd, int(p[i]), int(e[i])) for i in first[size == 1]]
            many = np.repeat(size > 1, size)
            p, e = p[many], e[many]
            if pd == depth or not len(p):
                first, size = _groups(p) if len(p) else (p, p)
                return whole, {int(p[i]): e[i : i + k] for i, k in zip(first, size, strict=True)}
        if pd < depth:
            p, e, pd = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e]), pd + 1
        if ed < e_depth:
            p, e, ed = np.concatenate([p, p]), np.concatenate([2 * e, 2 * e + 1]), ed + 1
            if ed == e_depth:
                e = book.leaf[e]
        pair = np.sort(p * (2 << e_depth) + e)
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
        p, e = pair // (2 << e_depth), pair % (2 << e_depth)


def _dominated(points: Nodes, pd: int, p: np.ndarray, e: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without entries that lose to the node's best entry (by its box' centre) everywhere in the box."""
    lo, hi, x = points.lo[pd][p], points.hi[pd][p], book.entries[e]
    off = lo + hi - 2 * x
    off = _squares(off)
    first, size = _groups(p)
    at = np.flatnonzero(off == np.repeat(np.minimum.reduceat(off, first), size))
    at = at[np.searchsorted(at, first)]
    won = np.repeat(e[at], size)
    w = book.entries[won]
    # |q - w|^2 - |q - x|^2 is linear in q: its greatest value lies in a corner
    step = x - w
    lead = np.einsum("ij,ij->i", 2 * np.where(step > 0, hi, lo) - w - x, step)
    keep = (e == won) | (lead > 0) | ((lead == 0) & (e < won))
    return p[keep], e[keep]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of the entries for each point, and its squared distance."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


class Block:
    """Vectors of a block with their trees, one for each part; x has the points as rows, parts side by side."""

    def __init__(self, x: np.ndarray, orders: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.x, self.orders, self.lo, self.hi, self.sums = x, orders, lo, hi, sums

    @classmethod
    def build(cls, x: np.ndarray) -> Block:
        n, width = len(x), x.shape[1] // PARTS
        levels = _levels(n, LEAF)
        cut = _borders(n, levels)[:-1]
        parts = [x[:, k * width : (k + 1) * width] for k in range(PARTS)]
        orders = np.stack([_order(p, levels) for p in parts])
        own = [p[o] for p, o in zip(parts, orders, strict=True)]
        fold = lambda f: np.stack([f.reduceat(p, cut, 0) if width else np.zeros((len(cut), 0), np.int64) for p in own])
        return cls(x, orders, fold(np.minimum), fold(np.maximum), fold(np.add))

    def assign(self, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        """(part, points in leaf order, entry of all of them, their sums) for nodes assigned whole, and
        (part, points, -1, entries) for points that were compared."""
        n, width = len(self.x), self.x.shape[1] // PARTS
        for k, book in enumerate(books):
            kind = book.entries.dtype
            cut = _borders(n, len(Nodes.over(self.lo[k], self.hi[k]).lo) - 1)
            points = Nodes.over(self.lo[k].astype(kind), self.hi[k].astype(kind))
            whole, left = candidates(points, book)
            depth = len(points.lo) - 1
            for level, node, entry in whole:
                a, b = node << (depth - level), (node + 1) << (depth - level)
                yield k, self.orders[k][cut[a] : cut[b]], entry, self.sums[k][a:b].sum(0)
            for leaf, entries in left.items():
                rows = self.orders[k][cut[leaf] : cut[leaf + 1]]
                at, _ = nearest(self.x[rows, k * width : (k + 1) * width].astype(kind), book.entries[entries])
                yield k, rows, -1, entries[at]


def _kind(books: list[np.ndarray], x: np.ndarray) -> type:
    """Doubles where every distance is exact in them."""
    top = max([int(np.abs(b).max(initial=0)) for b in books] + [int(np.abs(x).max(initial=0))])
    return np.float64 if (4 * top) ** 2 * max(1, x.shape[1]) < 1 << 53 else np.int64


_BLOCKS = "orders binary, lo binary, hi binary, sums binary, x binary, n int, width int"


def blocks(vectors: DataFrame) -> DataFrame:
    """(ids, labels, orders, lo, hi, sums, x, n, width): blocks of rows (vec_id, label, v) with the trees over their parts."""
    kinds = {c: t for c, t in vectors.dtypes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, labels, v = (t.column(c).combine_chunks() for c in ("vec_id", "label", "v"))
            flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64)
            x = matrix(flat, v.value_lengths().to_numpy().cumsum() if len(v) == 0 else np.r_[0, v.value_lengths().to_numpy().cumsum()], _LIMIT)
            if x.shape[1] % PARTS:
                raise ValueError(f"vectors of {x.shape[1]} components cannot be cut into {PARTS} equal parts")
            b = Block.build(x)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            raw = [b.orders.astype(np.int32), b.lo.astype(np.int32), b.hi.astype(np.int32), b.sums, x.astype(np.int32)]
            cols = [one(ids), one(labels), *(pa.array([r.tobytes()], pa.binary()) for r in raw), pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32())]
            return pa.RecordBatch.from_arrays(cols, ["ids", "labels", "orders", "lo", "hi", "sums", "x", "n", "width"])

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield flush()
                    n = 0
                held.append(part)
                n += part.num_rows
        if n:
            yield flush()

    return vectors.mapInArrow(run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, {_BLOCKS}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, width = batch.column("n")[i].as_py(), batch.column("width")[i].as_py()
            own = lambda c, kind, *shape: array_of(batch.column(c)[i], kind).reshape(*shape)  # noqa: B023, E731
            leaves = 1 << _levels(n, LEAF)
            boxes = (PARTS, leaves, width // PARTS)
            x = own("x", np.int32, n, width).astype(np.int64)
            yield batch, i, Block(x, own("orders", np.int32, PARTS, n), own("lo", np.int32, *boxes), own("hi", np.int32, *boxes), own("sums", np.int64, *boxes))


def _trees(books: list[np.ndarray], b: Block, made: dict) -> list[Codebook]:
    kind = _kind(books, b.x)
    if kind not in made:
        made[kind] = [Codebook(k.astype(kind)) for k in books]
    return made[kind]


def one_round(blocked: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment of all parts: every entry is its parts' mean, rounded down."""
    width = books[0].shape[1]
    sums = ", ".join(f"s{i} long" for i in range(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), width), np.int64)
        made: dict = {}
        for _, _, b in _read(batches):
            for part, rows, entry, what in b.assign(_trees(books, b, made)):
                if entry >= 0:
                    n[part, entry] += len(rows)
                    total[part, entry] += what
                else:
                    np.add.at(n[part], what, 1)
                    np.add.at(total[part], what, b.x[rows, part * width : (part + 1) * width])
        part, entry = np.nonzero(n)
        cols = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    schema = "part int, entry int, n long" + (f", {sums}" if width else "")
    got = blocked.drop("ids", "labels").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in got.collect():  # PARTS * ENTRIES rows at most
        out[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(blocked: DataFrame, books: list[np.ndarray], id_kind: str, label_kind: str) -> DataFrame:
    """(vec_id, label, code, error) of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch, i, b in _read(batches):
            codes, width = np.zeros((len(b.x), PARTS), np.int64), b.x.shape[1] // PARTS
            for part, rows, entry, what in b.assign(_trees(books, b, made)):
                codes[rows, part] = entry if entry >= 0 else what
            error = np.zeros(len(b.x), np.int64)
            for k in range(PARTS):
                off = b.x[:, k * width : (k + 1) * width] - books[k][codes[:, k]]
                error += (off * off).sum(1)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            own = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([own("ids"), own("labels"), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocked.mapInArrow(run, f"vec_id {id_kind}, label {label_kind}, code string, error long")


def learn(vectors: DataFrame, blocked: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one for each part; none where there are no vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    x = np.array([r["v"] for r in first], np.float64).astype(np.int64).reshape(len(first), -1)
    width = x.shape[1] // PARTS
    books = [x[:, k * width : (k + 1) * width].copy() for k in range(PARTS)]
    for _ in range(rounds):
        books = one_round(blocked, books)
    return books


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part."""
    kept = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled(F.col(vector_col), SCALE).alias("v"))
    kinds = dict(kept.dtypes)
    blocked = stage(blocks(kept), "vector-blocks")
    books = learn(kept, blocked)
    if not books:
        books = [np.zeros((1, 0), np.int64)] * PARTS
    out = stage(coded(blocked, books, kinds["vec_id"], kinds["label"]), "vector-codes")
    release(blocked)
    by_label = stage(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    n = by_label.count()
    small, salt = sized(by_label, n, 64), F.lit(0)
    if small is by_label:  # a label's rows are dealt out, and its sum copied to them
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int")
        small = by_label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    else:
        small = F.broadcast(by_label.withColumn("salt", F.lit(0)))
    a, b = out.withColumn("salt", salt).alias("a"), small.alias("b")
    j = a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return j.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
