"""Near-duplicate detection: SetSketch registers, banding, a joint likelihood estimate, exact confirmation.

1. Every text becomes the set of its word shingles, hashed to 64 bits, and a sketch of REGISTERS truncated
   minima with exponential spacing (base BASE). Such registers merge by their maximum and agree with
   a probability near the sets' similarity. Texts with equal sets form one class; one of each goes on.
2. Bands of ROWS registers put classes into buckets; buckets with the same members count once. Each
   bucket is walked as a graph whose links are joint maximum-likelihood estimates well above what chance gives:
   a node meets only those not reached yet, and the walk's tree is all that leaves the task. Buckets of more
   than BLOCK classes are dealt to tasks as pairs of blocks.
3. The trees' components hold all linked texts together. Within each the full sets are compared, again by a walk
   that meets only what is not reached. A component of more than SET_BLOCK classes is dealt to tasks in chunks: a few centres
   are compared with all members first, and what these stars join needs no further comparison among itself; only the
   members outside the largest star are then compared with all others. The confirmed trees give the final components.

A pair at similarity 0.8 misses all bands with a probability below (1 - 0.8**ROWS) ** (REGISTERS / ROWS), some
4e-7; the estimate's floor of 0.55 is more than six standard errors away.

Ids may be of any type that sorts; null comes last. Rows that repeat a doc_id with different texts are different documents,
in the order of their texts' 64-bit hashes; of a component the smallest row is kept, and rows that repeat both are marked
alike. Null or empty text, and text without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, rows_of, sized, small, stage, text_or_empty
from .components import components

REGISTERS, ROWS = 112, 4
BASE = 1.02
BLOCK, SET_BLOCK = 2048, 512
#: Shingles of one of the SET_BLOCK members of a group, on average at most.
SET_SHINGLES = 4096
#: Centres of a round, and rounds, before what is left outside the largest star meets all others.
CENTRES, ROUNDS = 16, 2
FLOOR = 0.55
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_RNG = np.random.default_rng(8)
_MUL = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text), A-Z lower-cased."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = _SPACES[buf]
    begin = ~space
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # texts end words
    begin[1:] &= space[:-1] | edge[1:n]
    starts = np.flatnonzero(begin)
    stop = ~space
    stop[:-1] &= space[1:] | edge[1:n]
    ends = np.flatnonzero(stop) + 1
    low = np.concatenate([_LOWER[buf], np.zeros(8, np.uint8)])
    v = np.ndarray((n + 1,), "<u8", low, 0, (1,))
    length = ends - starts
    h = length.astype(np.uint64) * _M[0]
    live = np.arange(len(starts))
    j = 0
    while len(live):
        take = np.minimum(length[live] - j, 8)
        h[live] = _mix(h[live] ^ (v[starts[live] + j] & _MASKS[take]) + _M[0])
        j += 8
        live = live[length[live] > j]
    return h, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all texts, each text's sorted and distinct; where each text's start)."""
    h, n = word_hashes(buf, offsets)
    texts = len(n)
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(texts), count)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    left = (first + n)[doc] - at  # words from here to the text's end
    s = np.full(len(doc), width, np.uint64)
    for j in range(width):
        ok = j < left
        s = np.where(ok, _mix((s ^ h[np.minimum(at + j, max(len(h) - 1, 0))]) * _M[0] + np.uint64(j)), s) if len(h) else s
    by = np.lexsort((s, doc))
    s, doc = s[by], doc[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(texts + 1))


def registers(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) of uint16: floor(1 - log_BASE of the smallest exponential variable), truncated to 16 bits."""
    texts = len(starts) - 1
    low = np.full((texts, REGISTERS), 0xFFFFFFFF, np.uint32)
    x = ((s >> np.uint64(32)) ^ s).astype(np.uint32)
    step = 4096
    for a in range(0, len(x), step):
        part = x[a : a + step, None]
        y = part * _MUL
        y += _ADD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        lo, hi = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, min(a + step, len(x)))
        own = np.arange(lo, hi)
        own = own[starts[own + 1] > starts[own]]
        got = np.minimum.reduceat(y, np.maximum(starts[own] - a, 0), axis=0)
        low[own] = np.minimum(low[own], got)
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)) + 2, 0, 65535).astype(np.uint16)


_GRID = np.linspace(0.0, 1.0, 41)


def joint_estimate(more: np.ndarray, less: np.ndarray, n_a: int, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from how many registers of a are above, and below, b's.

    For sets with shares u and v of their sizes' sum, a register of a is above with probability
    p(u - v J), below with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    n_b = np.asarray(n_b, float)
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1.0)
    up, down = p(u - v * _GRID), p(v - u * _GRID)
    same = np.clip(1 - up - down, 1e-9, 1.0)
    equal = REGISTERS - more - less
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
    fit = np.where(_GRID <= np.minimum(u / v, v / u) + 0.025, fit, -np.inf)
    return _GRID[np.argmax(fit, axis=1)]


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def _sketched(base: DataFrame, width: int) -> DataFrame:
    """doc_id, tie, n_shingles, s1, s2 (a 128-bit digest of the set), sketch; base: doc_id, tie, text."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2):
            s, at = shingle_sets(*_flat(b.column(2)), width)
            n = np.diff(at)
            sums = []
            for c in (0, 1):
                total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(s + _M[c]), dtype=np.uint64)])
                sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
            sig = registers(s, at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *sums, pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "tie", "n_shingles", "s1", "s2", "sketch"])

    return base.mapInArrow(run, f"doc_id {kind}, tie long, n_shingles long, s1 long, s2 long, sketch binary")


def _walk(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest: linked(i, rest) tells which of the nodes not yet reached are linked with i."""
    rest, tree = np.arange(n), []
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            hit = linked(i, rest)
            tree += [(i, int(k)) for k in rest[hit]]
            frontier += rest[hit].tolist()
            rest = rest[~hit]
    return tree


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for i, lo in enumerate(cuts):
            hi = cuts[i + 1] if i + 1 < len(cuts) else len(key)
            if held and key[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key[lo]
    if held:
        yield pa.Table.from_batches(held)


def _dealt(members: DataFrame, size: str, block: int, *key: str) -> DataFrame:
    """Groups with more than `block` members become all pairs of their blocks; adds gkey."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")
    m = members.withColumn("nb", n).withColumn("own", own)
    m = m.withColumn("other", F.explode(F.when(F.col("nb") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return m.withColumn("gkey", F.when(F.col("nb") <= 1, F.xxhash64(*key)).otherwise(F.xxhash64(*key, lo, hi))).drop("nb", "own", "other")


def _bucket_trees(dealt: DataFrame) -> DataFrame:
    """Edges (a, b) of each bucket's estimated graph; columns gkey, id, n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for t in _groups(batches):
            ids = t.column("id").to_numpy()
            size = t.column("n_shingles").to_numpy().astype(float)
            sig = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(ids), REGISTERS)

            def linked(i: int, rest: np.ndarray, sig=sig, size=size) -> np.ndarray:
                more, less = (sig[i] > sig[rest]).sum(1), (sig[i] < sig[rest]).sum(1)
                near = (more + less <= REGISTERS * (1 - FLOOR) + 8) & (np.minimum(size[rest], size[i]) >= FLOOR * np.maximum(size[rest], size[i]))
                hit = np.zeros(len(rest), bool)
                if near.any():
                    hit[near] = joint_estimate(more[near], less[near], size[i], size[rest[near]]) >= FLOOR
                return hit

            for i, k in _walk(len(ids), linked):
                a.append(int(ids[i]))
                b.append(int(ids[k]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _confirmed(dealt: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) with 100 * intersection >= percent * union; columns gkey, id, lead, shingles.

    A group without leads is walked; in one with leads, each of them is compared with all members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids = t.column("id").to_numpy()
            lists = t.column("shingles").combine_chunks()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(at)
            names, dense = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            mark = np.zeros(len(names), bool)

            def linked(i: int, rest: np.ndarray, size=size, at=at, dense=dense, mark=mark) -> np.ndarray:
                hit = np.zeros(len(rest), bool)
                fit = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
                some = rest[fit]
                if not len(some):
                    return hit
                own = dense[at[i] : at[i + 1]]
                mark[own] = True
                both = np.empty(len(some), np.int64)
                for lo in range(0, len(some), 256):
                    part = some[lo : lo + 256]
                    begin = np.cumsum(size[part]) - size[part]
                    flat = np.arange(int(size[part].sum())) + np.repeat(at[part] - begin, size[part])
                    both[lo : lo + 256] = np.add.reduceat(mark[dense[flat]].astype(np.int64), begin)
                mark[own] = False
                hit[fit] = 100 * both >= percent * (size[some] + size[i] - both)
                return hit

            leads = np.flatnonzero(t.column("lead").to_numpy(zero_copy_only=False))
            if len(leads):
                every = np.arange(len(ids))
                tree = [(i, int(k)) for i in leads.tolist() for k in every[linked(i, every)] if k != i]
            else:
                tree = _walk(len(ids), linked)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[i]) for i, _ in tree], pa.int64()), pa.array([int(ids[k]) for _, k in tree], pa.int64())], ["a", "b"])

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # leads come first in their groups
    return dealt.repartition(parts, "gkey").sortWithinPartitions("gkey", F.desc("lead"), "id").mapInArrow(run, "a long, b long")


def _led(members: DataFrame, leads: DataFrame, part: int) -> DataFrame:
    """Groups in which leads (component, id) meet all members of their component.

    Members are dealt to chunks of SET_BLOCK; the leads, in parts of `part`, go to every chunk, and the members to every part.
    """
    n_parts = leads.groupBy("component").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
    chunks = F.ceil(F.col("size") / F.lit(SET_BLOCK)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    m = members.join(n_parts, "component").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), chunks).cast("int")).withColumn("part", upto(F.col("parts")))
    lead = members.join(leads.select("component", "id"), ["component", "id"], "left_semi").join(n_parts, "component")
    lead = lead.withColumn("part", F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts")).cast("int")).withColumn("chunk", upto(chunks))
    key = F.xxhash64("component", "chunk", "part").alias("gkey")
    columns = ["id", "shingles"]
    return m.select(key, *columns, F.lit(False).alias("lead")).unionByName(lead.select(key, *columns, F.lit(True).alias("lead")))


def _outside(members: DataFrame, links: DataFrame) -> DataFrame:
    """(component, id) of the members that are not in their component's largest star."""
    star = members.select("component", "id").join(components(links).withColumnRenamed("component", "star"), "id", "left")
    star = stage(star.select("component", "id", F.coalesce("star", "id").alias("star")), "stars")
    size = star.groupBy("component", "star").agg(F.count("*").alias("n"))
    largest = size.groupBy("component").agg(F.max_by("star", F.struct("n", "star")).alias("largest"))
    return stage(star.join(largest, "component").filter("star != largest").select("component", "id"), "outside")


def _large_links(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed edges within large components; members: id, component, size, shingles, staged."""
    open_ = members.select("component", "id")
    links = None
    for round_ in range(ROUNDS):
        n = open_.groupBy("component").agg(F.count("*").alias("n_open"))
        leads = open_.join(n, "component").filter(F.pmod(F.xxhash64("id", F.lit(round_)), F.col("n_open")) < CENTRES).select("component", "id")
        found = stage(_confirmed(_led(members, stage(leads, "centres"), CENTRES * 4), percent), "star-links")
        links = found if links is None else links.unionByName(found)
        open_ = _outside(members, links)
        if not open_.limit(1).count():
            return links
    return links.unionByName(stage(_confirmed(_led(members, open_, SET_BLOCK // 2), percent), "last-links"))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_tie: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; with_tie adds the text's hash."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    marks = stage(_sketched(base, width), "sketches")
    digest = ["n_shingles", "s1", "s2"]
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tie")
    # classes get numbers of their own; they are written, so the numbers stay
    classes = marks.filter("n_shingles > 0").groupBy(*digest).agg(F.min(place).alias("place"), F.first("sketch").alias("sketch"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    one = classes.select("id", "n_shingles", "sketch")
    step = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * step + 1, step)) for i in range(REGISTERS // ROWS)])
    banded = one.select("id", F.explode(bands).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("c1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("c2"))
    buckets = stage(buckets.filter("size > 1").groupBy("size", "c1", "c2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    members = banded.join(sized(buckets, buckets.count(), 32), "bucket")
    dealt = _dealt(members, "size", BLOCK, "bucket").select("gkey", "id").join(one, "id").select("gkey", "id", "n_shingles", "sketch")
    trees = stage(_bucket_trees(dealt.repartition(parts, "gkey").sortWithinPartitions("gkey", "id")), "bucket-trees")
    near = components(trees)
    near = near.join(classes.select("id", "n_shingles", "place.doc_id", "place.tie"), "id")
    # long texts count for several: what a task holds goes with the shingles of its group
    sizes = near.groupBy("component").agg(F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / SET_SHINGLES)).alias("size"))
    near = near.join(sizes, "component")
    near = stage(near.select("id", "component", "size", "doc_id", "tie"), "near")
    n_near, n_large = near.select(F.count("*"), F.count_if(F.col("size") > SET_BLOCK)).first()

    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.tie") == F.col("c.tie"))
    asked = base.alias("d").join(sized(near, n_near, 56).alias("c"), same).select("id", "text", "component", "size")
    if marks.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        asked = asked.dropDuplicates(["id"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            s, at = shingle_sets(*_flat(b.column(1)), width)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), lists], ["id", "component", "size", "shingles"])

    sets = lambda rows: rows.mapInArrow(with_sets, "id long, component long, size long, shingles array<long>")
    few = sets(asked.filter(F.col("size") <= SET_BLOCK))
    links = stage(_confirmed(few.select(F.xxhash64("component").alias("gkey"), "id", F.lit(False).alias("lead"), "shingles"), percent), "links")
    if n_large:
        links = links.unionByName(_large_links(stage(sets(asked.filter(F.col("size") > SET_BLOCK)), "large-sets"), percent))
    final = components(links).withColumnRenamed("component", "joined")
    ids = stage(classes.join(final, "id", "left").select(*digest, "place", F.coalesce("joined", "id").alias("joined")), "joined")
    first = ids.groupBy("joined").agg(F.min("place").alias("first"))
    ids = ids.join(first, "joined").select(*digest, "first")
    out = marks.drop("sketch").join(ids, digest, "left")
    own = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    for t in (buckets, trees):
        release(t)
    kept = F.coalesce(place.eqNullSafe(F.col("first")) | F.col("first").isNull(), F.lit(True))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"), *(["tie"] if with_tie else []))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, with its own columns; of rows that repeat a doc_id and a text one stays."""
    kept = near_components(docs, width, percent, id_col, text_col, with_tie=True).filter("kept").select("doc_id", "tie")
    return rows_of(docs, kept, doc_id=F.col(f"d.`{id_col}`"), tie=F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))))
