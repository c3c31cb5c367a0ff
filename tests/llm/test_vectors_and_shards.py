"""Hard negatives, vector codes and shards against plain versions, and their SQL."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmesh.llm import hard_negatives as hn
from fieldmesh.llm import sharding, vector_codes
from fieldmesh.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_histogram_shards", "op13_vector_codes"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {f} AS SELECT * FROM '{DIR}/{f}.parquet'")
    df, r = QUERIES[name](spark, DIR), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    place = [r.columns.index(c) for c in cols]
    got = Counter(tuple(x[c] for c in cols) for x in df.collect())
    assert got == Counter(tuple(x[i] for i in place) for x in r.fetchall()) and got


# --- hard negatives -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (65, 64, 131), (128, 96, 64)])
def test_strassen(shape):
    n, k, m = shape
    rng = np.random.default_rng(n)
    for top in (3, 1 << 20, 1 << 28):
        a, b = rng.integers(-top, top, (n, k)), rng.integers(-top, top, (k, m))
        assert (hn.strassen(a, b, 4) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    rows = np.stack([rng.integers(0, 4, 300), rng.integers(0, 5, 300), rng.integers(0, 2, 300), rng.integers(0, 6, 300), np.arange(300)])
    want = []
    for h in range(4):
        own = sorted((-s, null, i, k) for g, s, null, i, k in rows.T.tolist() if g == h)
        want += [(h, -s, null, i, k) for s, null, i, k in own[:5]]
    for size in (1, 7, 300):
        heaps = hn.Heaps(4, 5)
        for at in range(0, 300, size):
            heaps.add(*rows[:, at : at + size])
        assert list(zip(heaps.heap.tolist(), *(e.tolist() for e in heaps.entries), strict=True)) == want
        assert heaps.floor.tolist() == [want[5 * h + 4][1] for h in range(4)]


def plain_negatives(rows):
    own = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, k, math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label, [math.floor(x * 256) for x in v]))
    out = Counter()
    for a in own:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[3], b[3], strict=True)), b[0] is None, b[0] or 0, b[1], b) for b in own if b is not a), key=lambda t: t[:4])
        for p in [t for t in scored if t[4][2] == a[2]][:5]:
            negatives = [t for t in scored if t[4][2] != a[2] and 80 * -p[0] <= 100 * -t[0] <= 100 * -p[0]][:5]
            out.update((a[0], p[4][0], r + 1, t[4][0], -p[0], -t[0]) for r, t in enumerate(negatives))
    return out


VECTORS = "vec_id long, embedding array<float>, label int, a_block string, number int, meet string"


def messy(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.25, 1.0]) for _ in range(8)]
        rows.append((rng.choice([k, k % 40 * 10, 100]), v, rng.randrange(3)))
    rows += [(None, [0.25] * 8, 1), (100, [0.25] * 8, None), (200, None, 1), (300, [0.1] * 7 + [None], 1), (400, [0.1] * 7 + [math.nan], 1), (500, [0.1] * 7 + [math.inf], 2), (-700, [1.0] * 8, 1), (0, [0.0] * 8, 2)]
    return rows


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 37)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "STRIPE", 600)
    for seed in (1, 2):
        rows = messy(seed)
        df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
        got = Counter(tuple(r) for r in hn.hard_negatives(df).collect())
        assert got == plain_negatives(rows) and got
    assert hn.hard_negatives(df.limit(0)).count() == 0
    assert hn.hard_negatives(df.filter("vec_id = 1")).count() == 0
    with pytest.raises(Exception, match="components"):
        hn.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int").coalesce(1)).count()


# --- vector codes -------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    own = [(i, label, [math.floor(x * 1024) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(own[0][2]) // 4
    part = lambda v, k: v[k * width : (k + 1) * width]
    books = [[part(v, k) for _, _, v in own[:entries]] for k in range(4)]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for k, book in enumerate(books):
            groups = defaultdict(list)
            for _, _, v in own:
                groups[nearest(part(v, k), book)[1]].append(part(v, k))
            new.append([[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, label, v in own:
        near = [nearest(part(v, k), books[k]) for k in range(4)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near)))
        by_label[label] += out[-1][3]
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("entries", [256, 5, 1])
def test_vector_codes(spark, monkeypatch, entries):
    monkeypatch.setattr(vector_codes, "LEAF", 4)
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    monkeypatch.setattr(vector_codes.learn, "__defaults__", (entries, 4))
    rows = messy(entries)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(4)
    assert Counter(tuple(r) for r in vector_codes.vector_codes(df).collect()) == plain_codes(rows, entries)


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    empty = vector_codes.vector_codes(spark.createDataFrame([(1, None, 2)], kind))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    bare = vector_codes.vector_codes(spark.createDataFrame([(1, [], 2), (2, [], None)], kind)).collect()
    assert [(r["code"], r["error"]) for r in bare] == [("00000000", 0)] * 2
    for vectors, message in (([[1.0] * 4, [1.0] * 8], "components"), ([[1.0] * 6], "cut into"), ([[1e30] * 4], "below")):
        with pytest.raises(Exception, match=message):
            vector_codes.vector_codes(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], kind).coalesce(1)).count()


def test_whole_nodes_and_wide_integers():
    """Clusters far apart are assigned by node; components beyond what doubles hold are compared as integers."""
    rng = np.random.default_rng(5)
    for far, dtype in ((1000, np.float64), (1 << 26, np.int64)):
        x = np.repeat(rng.integers(-far, far, (6, 8)), 90, 0) + rng.integers(-1, 2, (540, 8))
        books = [x[::90, k * 2 : k * 2 + 2] for k in range(4)]
        assert vector_codes._kind(books, x) is dtype
        found, whole = np.full((540, 4), -1), 0
        for part, rows, entry, what in vector_codes.Block.build(x).assign([vector_codes.Codebook(b.astype(dtype)) for b in books]):
            whole += len(rows) * (entry >= 0)
            found[rows, part] = entry if entry >= 0 else what
            assert entry < 0 or (what == x[rows, part * 2 : part * 2 + 2].sum(0)).all()
        for k in range(4):
            d = ((x[:, None, k * 2 : k * 2 + 2] - books[k][None]) ** 2).sum(2)
            assert (found[:, k] == d.argmin(1)).all()
        assert whole > 540


# --- shards -------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, key string, shard int, slot int"


def checked_shards(rows, got, n):
    """What every result must have; gives the shards' sizes."""
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sizes = defaultdict(list), [0] * n
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return sizes


def test_shards_are_near_equal(spark):
    rng = random.Random(4)
    rows = [(i, "w" * rng.randrange(60)) for i in range(1500)]
    rows += [(5000 + i, "a group of copies that holds a third of all bytes") for i in range(900)] + [(7, "same id and text")] * 300 + [(None, None), (None, ""), (8, None)]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DOCS).repartition(5)
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    for n in (16, 3):
        got = sharding.shard(df, n).collect()
        sizes = checked_shards(rows, got, n)
        # a splitter is within the tolerance or within half a row of its share
        assert max(abs(s - total / n) for s in sizes) <= 2 * max(total / n / sharding.SLACK, 31)
    text = dict(rows)
    spread = defaultdict(set)
    for r in sharding.shard(df, 3).collect():
        spread[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 2  # a splitter cuts one group at most


def test_shards_of_odd_tables(spark):
    kind = "doc_id string, text string"
    assert sharding.shard(spark.createDataFrame([], kind)).count() == 0
    one = sharding.shard(spark.createDataFrame([("a", "x" * 100_000), ("b", "y")], kind)).collect()
    checked_shards([("a", "x" * 100_000), ("b", "y")], one, 16)
    same = sharding.shard(spark.createDataFrame([("a", "x")] * 64, kind).repartition(4)).collect()
    assert set(checked_shards([("a", "x")] * 64, same, 16)) == {8}


def test_shards_written(spark, tmp_path):
    rows = [(i, f"text {i % 50}" * (i % 7)) for i in range(400)]
    df = spark.createDataFrame([(*r, f"k{r[0]}", 1, 2) for r in rows], DOCS)
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["doc_id"], r["text"], r["key"]) for r in back.collect()) == sorted((i, t, f"k{i}") for i, t in rows)
    want = {(r["doc_id"]): (r["shard"], r["slot"]) for r in sharding.shard(df, 4).collect()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back.collect()} == want


def test_shards_use_no_python(spark):
    plan = sharding.shard(spark.createDataFrame([("a", "x")], "doc_id string, text string").withColumn("n", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
