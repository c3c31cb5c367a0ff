"""Removal of byte strings that also start earlier in the corpus, by suffix sorting of the places that can repeat.

Every window of LENGTH bytes takes the smallest hash of the GRAM-byte strings inside it as its anchor; equal windows
have equal anchors, and consecutive windows with one anchor form a run (about LENGTH - GRAM bytes apart).

1. Anchors are counted over the corpus (summed per task first). Runs whose anchor occurs once hold no repeat.
2. The other runs are classed by (anchor, BLAKE2b digest of the run's whole text). Within a class all runs but
   the first are repeats entirely; copies never meet one another, so a hot group is summed before it is shuffled.
3. Where an anchor has several classes, or stands in a run more than once, one run of each is fetched, and the windows
   of an anchor's runs are sorted as suffixes, deep-shallow: by eight-byte characters to a shallow depth, as multikey
   quicksort does, then blind tries order the groups that still tie. A trie keeps its branching positions: a suffix is
   compared with the head of its node once, and one byte of it is read wherever that node branches later. Windows that
   tie to LENGTH are equal; all but the first are repeats.
4. Anchors with more classes than a task should sort are split: their windows are dealt to tasks by ranges of
   their bytes and places, sorted there in the same way, and neighbouring tasks' borders are compared.
5. Spans are merged per document, cut out, and the rest is hashed.

Documents are ordered by doc_id, null last. Rows that repeat a doc_id with different texts are different documents, in
the order of their texts' 64-bit hashes; rows that repeat both are one document, and each loses the same spans. Null text is
empty; texts shorter than LENGTH are kept whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, sized, small, stage, text_or_empty

LENGTH, GRAM = 100, 24
#: Windows of a run at most; longer ones (periodic text) are cut.
RUN = 128
#: Bytes that are hashed at a time, so that the arrays stay in the cache.
SEGMENT = 1 << 17
#: Bytes compared by the shallow sort; those that tries look at; suffixes compared with their heads at a time.
SHALLOW = 24
DEEP = np.arange(SHALLOW, LENGTH)
TRIE_ROWS = 100_000
#: Classes of an anchor that are sorted in one task; an anchor with more is split, RANGE windows to a task.
CLASSES, RANGE = 8192, 400_000
#: What names a document.
DOC = ("doc_id", "tie")
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; buf is padded."""
    n = len(buf) - GRAM + 1
    v = np.ndarray((n + 16,), "<u8", buf, 0, (1,)) if n > 0 else np.zeros(0, np.uint64)
    if n <= 0:
        return v
    h = v[:n] * _C[0]
    x = v[8 : n + 8] * _C[1]
    x ^= x >> np.uint64(29)
    h ^= x
    np.multiply(v[16 : n + 16], _C[2], out=x)
    x ^= x >> np.uint64(31)
    h += x
    h ^= h >> np.uint64(32)
    h *= _C[3]
    h ^= h >> np.uint64(29)
    return h


def _window_minima(h: np.ndarray) -> np.ndarray:
    span, step, m = LENGTH - GRAM + 1, 1, h
    while step * 2 <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = span - step
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in the document, windows, anchor, twice) of the runs of a batch of texts.

    twice: the anchor stands at several places of the run's text, so that one of its windows may repeat another.
    """
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    total = len(buf)
    starts_of_docs = offsets[:-1]
    for a in range(0, max(0, total - LENGTH + 1), SEGMENT):
        size = min(SEGMENT, total - LENGTH + 1 - a)
        part = np.ascontiguousarray(buf[a : a + size + LENGTH - 1])
        h = _gram_hashes(part)
        m = _window_minima(h)[:size]
        new = np.empty(size, bool)
        new[0] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        lo, hi = np.searchsorted(starts_of_docs, [a, a + size])
        new[starts_of_docs[lo:hi] - a] = True
        s = np.flatnonzero(new)
        # With a period shorter than the run, the anchor is a first string of one window and the last of another.
        heads, tails = np.flatnonzero(h[:size] == m), np.flatnonzero(h[LENGTH - GRAM : LENGTH - GRAM + size] == m)
        first, last = np.full(len(s), -1), np.full(len(s), -1)
        first[np.searchsorted(s, heads[::-1], side="right") - 1] = heads[::-1]
        last[np.searchsorted(s, tails, side="right") - 1] = tails + LENGTH - GRAM
        twice = (first >= 0) & (last >= 0) & (first != last)
        doc = np.searchsorted(offsets, s + a, side="right") - 1
        end = np.minimum(np.append(s[1:], size), offsets[doc + 1] - LENGTH + 1 - a)
        n = end - s
        keep = n > 0
        s, n, doc, twice = s[keep], n[keep], doc[keep], twice[keep]
        if len(n) and n.max() > RUN:
            times = -(-n // RUN)
            which = np.repeat(np.arange(len(s)), times)
            k = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            s, n, doc = s[which] + k * RUN, np.minimum(n[which] - k * RUN, RUN), doc[which]
            twice = twice[which]
        for out, x in zip(found, (doc, s + a - offsets[doc], n, m[s].view(np.int64), twice), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, and where each row starts; without nulls."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def _doc_schema(base: DataFrame) -> str:
    return f"doc_id {base.schema['doc_id'].dataType.simpleString()}, tie long"


def _runs(base: DataFrame, only_anchor: bool) -> DataFrame:
    """The anchors of the texts (key, n: 1, or 2 for twice or more), or their runs; base: doc_id, tie, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2):
            buf, offsets = _flat(b.column(2))
            doc, start, n, key, twice = runs(buf, offsets)
            if only_anchor:
                u, c = np.unique(np.concatenate([key, key[twice.astype(bool)]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.minimum(c, 2).astype(np.int8))], ["key", "n"])
            else:
                raw, begin = memoryview(buf), offsets[doc] + start
                got = b"".join([hashlib.blake2b(raw[i:k], digest_size=16).digest() for i, k in zip(begin.tolist(), (begin + n + LENGTH - 1).tolist(), strict=True)])
                d1, d2 = np.frombuffer(got, np.int64).reshape(-1, 2).T
                take = pa.array(doc)
                cols = [pa.array(key), pa.array(d1), pa.array(d2), b.column(0).take(take), b.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice.astype(np.int8))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "d1", "d2", "doc_id", "tie", "start", "n", "twice"])

    return base.mapInArrow(run, "key long, n byte" if only_anchor else f"key long, d1 long, d2 long, {_doc_schema(base)}, start int, n int, twice byte")


def deep_shallow(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the LENGTH-byte windows of buf that start at `at`: (order, group); equal windows share a group.

    The groups are numbered in the order of the windows' bytes.
    """
    n = len(at)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    v = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # where the group starts in the order
    tied = np.ones(n, bool) if n > 1 else np.zeros(n, bool)

    def split(places: np.ndarray, value: np.ndarray, along: np.ndarray | None = None) -> None:
        """Order the tied places by (group, value) and part the groups where the value changes."""
        by = np.lexsort((value, group[places]))
        order[places] = order[places][by]
        if along is not None:
            along[places] = along[places][by]
        g, x = group[places], value[by]
        new = np.ones(len(places), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        heads = places[new]
        group[places] = heads[np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(places)))
        tied[places] = np.repeat(size > 1, size)

    for depth in range(0, SHALLOW, 8):
        places = np.flatnonzero(tied)
        if not len(places):
            return order, group
        split(places, v[at[order[places]] + depth].astype(np.uint64))
    # blind tries, a level of all of them at a time; common: the first byte in which a suffix differs from its node's head
    common = np.full(n, -1)
    places = np.flatnonzero(tied)
    while len(places):
        g = group[places]
        heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        which = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(places))))
        head = order[places[heads]][which]
        new = np.flatnonzero(common[places] < 0)
        for lo in range(0, len(new), TRIE_ROWS):
            some = new[lo : lo + TRIE_ROWS]
            differs = padded[at[order[places[some]]][:, None] + DEEP] != padded[at[head[some]][:, None] + DEEP]
            common[places[some]] = np.where(differs.any(1), differs.argmax(1) + SHALLOW, LENGTH)
        branch = np.minimum.reduceat(common[places], heads)
        inner = branch[which] < LENGTH  # the others are equal to the end
        places, which = places[inner], which[inner]
        if len(places):
            split(places, padded[at[order[places]] + branch[which]], common)
            # who left the head's way is compared with a new head
            common[places[common[places] <= branch[which]]] = -1
            places = places[tied[places]]
            first = places == group[places]
            common[places[first]] = LENGTH
    return order, group


def repeated(pieces: list[bytes], rank: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows that also start earlier; rank: the order of the pieces' places."""
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    base = np.cumsum([0, *map(len, pieces)])[:-1]
    piece = np.repeat(np.arange(len(pieces)), n)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    order, group = deep_shallow(buf, base[piece] + window)
    by = np.lexsort((window[order], rank[piece[order]], group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by][1:] == group[by][:-1]
    hit = order[by[later]]
    return piece[hit], window[hit]


def _ranked(rows: pa.Table, *places: str) -> np.ndarray:
    """Each row's rank by document and place, nulls last."""
    by = pc.sort_indices(rows, [(c, "ascending") for c in (*DOC, *places)], null_placement="at_end").to_numpy()
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return rank


def _sort_pieces(pieces: DataFrame) -> DataFrame:
    """doc_id, tie, start, lo, hi: the repeated windows of pieces that come dealt and sorted by key."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        n = rows.column("n").to_numpy().astype(np.int64)
        piece, window = repeated(rows.column("piece").to_pylist(), _ranked(rows, "start"), n)
        by = np.lexsort((window, piece))
        piece, window = piece[by], window[by]
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(piece))[: len(first)] - 1
        cols = [rows.column(c).take(pa.array(piece[first])).combine_chunks() for c in (*DOC, "start")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(window[first].astype(np.int32)), pa.array((window[last] + 1).astype(np.int32))], [*DOC, "start", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 2048:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield solve(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return pieces.mapInArrow(run, f"{_doc_schema(pieces)}, start int, lo int, hi int")


def _sort_ranges(pieces: DataFrame, n_windows: int) -> DataFrame:
    """The same for anchors with very many classes: windows are dealt by ranges of (bytes, place), so that no task gets an unbounded group."""
    w = pieces.select(*DOC, "start", "piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lo"))
    w = w.select(*DOC, "start", "lo", F.expr(f"substring(piece, lo + 1, {LENGTH})").alias("window"))
    dealt = w.repartitionByRange(max(1, -(-n_windows // RANGE)), "window", F.col("doc_id").asc_nulls_last(), "tie", F.col("start") + F.col("lo"))
    kind = _doc_schema(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits, then the task's first window and its last one's bytes."""
        held = list(batches)
        t = pa.Table.from_batches(held) if held else None
        if t is None or not t.num_rows:
            return
        raw = t.column("window").to_pylist()
        order, group = deep_shallow(np.frombuffer(b"".join(raw), np.uint8), np.arange(len(raw)) * LENGTH)
        by = order[np.lexsort((_ranked(t, "start", "lo")[order], group))]
        same = np.zeros(len(by), bool)
        same[1:] = group[1:] == group[:-1]
        some = pa.array(np.append(by[same], by[0]))
        cols = [t.column(c).take(some).combine_chunks() for c in (*DOC, "start", "lo")]
        none = [None] * int(same.sum())
        cols += [pa.array([*none, raw[by[0]]], pa.binary()), pa.array([*none, raw[by[-1]]], pa.binary()), pa.array(np.full(len(some), TaskContext.get().partitionId()))]
        yield pa.RecordBatch.from_arrays(cols, [*DOC, "start", "lo", "first", "last", "part"])

    found = stage(dealt.mapInArrow(run, f"{kind}, start int, lo int, first binary, last binary, part long"), "ranges")
    # one row for each task: its first window repeats if the task before ends with the same
    borders = found.filter("first IS NOT NULL").withColumn("before", F.lag("last").over(W.orderBy("part")))
    hit = found.filter("first IS NULL").drop("first", "last", "part").unionByName(borders.filter("first = before").drop("first", "last", "part", "before"))
    return hit.withColumn("hi", F.col("lo") + 1)


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))


def repeat_spans(base: DataFrame, again: bool = False) -> DataFrame:
    """(doc_id, tie, spans): the maximal removed byte runs of each document that has any, in order; again: doc_ids repeat."""
    counted = _runs(base, True).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    shared = stage(counted, "anchors")
    occ = stage(_runs(base, False).join(sized(shared, shared.count(), 24), "key"), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tie", "start")
    # anchors with several classes, or with several places in one run
    several = occ.groupBy("key").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)), F.max("twice").alias("twice"))
    several = stage(several.filter("min_d1 != max_d1 OR min_d2 != max_d2 OR twice = 1").select("key"), "mixed-anchors")
    first = occ.groupBy("key", "d1", "d2").agg(F.min(F.struct(place.alias("place"), "n")).alias("first"), F.count("*").alias("copies"))
    copied = first.filter("copies > 1").select("key", "d1", "d2", F.col("first.place").alias("first"))
    whole = occ.join(copied, ["key", "d1", "d2"]).filter(~place.eqNullSafe(F.col("first")))
    whole = whole.select(*DOC, F.col("start").alias("lo"), (F.col("start") + F.col("n") + LENGTH - 1).alias("hi"))
    reps = first.join(sized(several, several.count(), 24), "key").select("key", "first.place.doc_id", "first.place.tie", "first.place.start", "first.n")
    reps = stage(reps, "classes")
    wanted = reps.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "key")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2):
            buf, offsets = _flat(b.column(2))
            raw, lists = buf.tobytes(), b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.flatten()
            start, n, key = (flat.field(i).to_numpy() for i in range(3))
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            begin = offsets[doc] + start
            got = [raw[i : i + k + LENGTH - 1] for i, k in zip(begin.tolist(), n.tolist(), strict=True)]
            for i in range(0, len(got), 20_000):
                j = slice(i, i + 20_000)
                take = pa.array(doc[j])
                yield pa.RecordBatch.from_arrays([pa.array(key[j]), b.column(0).take(take), b.column(1).take(take), pa.array(start[j]), pa.array(n[j]), pa.array(got[j], pa.binary())], ["key", *DOC, "start", "n", "piece"])

    asked = base.alias("d").join(sized(wanted, reps.count(), 28).alias("w"), _same_doc("d", "w")).select("d.doc_id", "d.tie", "d.text", "w.wanted")
    if again:
        asked = asked.dropDuplicates([*DOC])
    pieces = asked.mapInArrow(cut, f"key long, {_doc_schema(base)}, start int, n int, piece binary")
    crowded = reps.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("windows")).filter(F.col("classes") > CLASSES)
    crowded = stage(crowded.select("key", "windows"), "crowded")
    n_crowded, n_windows = crowded.select(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0))).first()
    few = pieces.join(sized(crowded.select("key"), n_crowded, 24), "key", "left_anti") if n_crowded else pieces
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = _sort_pieces(few.repartition(parts, "key").sortWithinPartitions("key"))
    if n_crowded:
        hits = hits.unionByName(_sort_ranges(pieces.join(sized(crowded.select("key"), n_crowded, 24), "key", "left_semi"), n_windows))
    some = hits.select(*DOC, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + LENGTH - 1).alias("hi"))
    # islands of touching spans
    w = W.partitionBy(*DOC).orderBy("lo", "hi")
    spans = whole.unionByName(some).withColumn("reach", F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("lo") > F.col("reach"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy(*DOC, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = stage(spans.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")
    for t in (occ, reps, shared, several, crowded):
        release(t)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds the remaining bytes and the spans."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    again = base.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    base = base.select("doc_id", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("tie"), "text")
    spans = repeat_spans(base, again)
    size = spans.select(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    kind = base.schema["doc_id"].dataType.simpleString()
    joined = base.alias("d").join(sized(spans, size[0] * 2 + size[1], 16).alias("s"), _same_doc("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            texts, spans = b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()
            out, kept = [], []
            for raw, own in zip(texts, spans, strict=True):
                parts, at, gone = [], 0, 0
                for x in own or ():
                    parts.append(raw[at : x["lo"]])
                    gone += x["hi"] - x["lo"]
                    at = x["hi"]
                parts.append(raw[at:])
                rest = b"".join(parts)
                out.append((len(raw), gone, len(own or ()), hashlib.sha256(rest).hexdigest()))
                kept.append(rest)
            cols = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)] + [pa.array([o[3] for o in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(kept, pa.binary()), b.column(2)]
                names += ["kept_bytes", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    more = ", kept_bytes binary, spans array<struct<lo:int,hi:int>>" if with_text else ""
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
