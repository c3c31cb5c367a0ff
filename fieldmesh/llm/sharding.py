"""Sharding into shards of near equal bytes by histogram sort, in DataFrame functions only.

Every row has a key of hexadecimal digits: its text's digest, its id's digest, its row number in the table that is written with
the keys. Equal texts are neighbours in this order, and no two rows share a key. Then:

1. Probes are the starts of all prefixes of some digits. One job counts the bytes and rows of each prefix, over all tasks, so the
   bytes below every probe are known exactly.
2. A splitter is settled at the probe nearest to its share of all bytes once that is within the tolerance (`SLACK`, a part of a
   shard). The prefixes in which the others lie are refined by further digits and counted again, until all are settled or the
   keys' digits are used up; then the nearest place between two rows is taken.
3. Prefixes with more rows than a task should sort are refined in the same way. The probes cut the shards into ranges of rows,
   and as the rows below every probe are known too, so is the first slot of every range.
4. The rows are exchanged once, by range, and ranked inside their range.

The first digits are the text's, so a splitter falls between groups of equal texts wherever such a place is near enough; only a
group of more than about the tolerance is cut, by its ids.

Defined cases: a null text is empty, has no bytes and is in one group with empty texts; a null id counts as empty; rows that are
repeated are told apart by their row number and get a slot each; an empty table gives no rows; a text larger than a shard leaves
its neighbours empty; other columns are ignored, whatever their names, and come along unread with `carry`.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: A splitter is settled within a shard's bytes divided by this.
SLACK = 200
#: Digits of a key: text, id, row number.
DIGITS = 32 + 32 + 16
#: Counted prefixes that the driver holds at a time, at most.
PROBES = 1 << 18
#: Digits of the cells by which rows find their range.
CELL = 3
#: Sorts after every key.
_END = "g"


@dataclass(frozen=True)
class Probe:
    """A place in the order of keys, and what lies below it."""

    start: str
    size: int
    rows: int


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, key (and row, the whole row) of every row; written, so that row numbers stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    key = F.concat(F.md5(text), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lower(number))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    size = (F.octet_length(text) + 1).cast("long")
    return stage(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"), *row), "shard-keys")


def _count(rows: DataFrame, cells: list[str], depth: int, step: int) -> dict[str, tuple[int, int]]:
    """(bytes, rows) of the prefixes that are `step` digits longer than the cells."""
    own = rows.filter(F.substring("key", 1, depth).isin(cells)) if depth else rows
    got = own.groupBy(F.substring("key", 1, min(depth + step, DIGITS)).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return {r["p"]: (r["size"], r["rows"]) for r in got.collect()}


def _step(cells: int) -> int:
    """Digits by which so many cells can be refined at once."""
    return next((s for s in (3, 2) if cells * 16**s <= PROBES), 1)


def _probes(found: dict[str, tuple[int, int]]) -> list[Probe]:
    out, size, rows = [], 0, 0
    for p in sorted(found):
        out.append(Probe(p, size, rows))
        size, rows = size + found[p][0], rows + found[p][1]
    return [*out, Probe(_END, size, rows)]


def _splitters(rows: DataFrame, first: dict[str, tuple[int, int]], n: int) -> list[Probe]:
    """The n - 1 inner borders of the shards."""
    step = _step(n)
    depth, found, settled = step, dict(first), {}
    while True:
        probes = _probes(found)
        total = probes[-1].size
        todo = set()
        for k in range(1, n):
            if k in settled:
                continue
            off, best = min(((abs(n * p.size - k * total), p) for p in probes), key=lambda x: (x[0], x[1].size))
            # the prefix that holds the k-th share
            holder = max((p for p in probes[:-1] if n * p.size <= k * total), key=lambda p: p.size).start
            if off * SLACK <= total or depth >= DIGITS or found[holder][1] == 1:
                settled[k] = best
            else:
                todo.add(holder)
        if not todo:
            return [settled[k] for k in range(1, n)]
        more = _count(rows, sorted(todo), depth, step)
        depth = min(depth + step, DIGITS)
        found = {p: v for p, v in found.items() if p not in todo} | more


def _cuts(rows: DataFrame, first: dict[str, tuple[int, int]], depth: int, most: int) -> list[Probe]:
    """Probes between which at most `most` rows lie, but for prefixes that cannot be refined."""
    found = dict(first)
    while depth < DIGITS:
        todo = sorted(p for p, (_, k) in found.items() if len(p) == depth and k > most)
        if not todo:
            break
        step = _step(len(todo))
        more = _count(rows, todo, depth, step)
        found = {p: v for p, v in found.items() if p not in set(todo)} | more
        depth = min(depth + step, DIGITS)
    return _probes(found)[:-1]


def _ranges(splitters: list[Probe], cuts: list[Probe], most: int) -> list[dict]:
    """The ranges that are exchanged: where each starts, its number, its shard, its first slot."""
    places = sorted({p.start: p for p in [Probe("", 0, 0), *cuts, *splitters]}.values(), key=lambda p: p.start)
    borders = [s.start for s in splitters]
    out: list[dict] = []
    shard, shard_rows, last = -1, 0, 0
    for i, p in enumerate(places):
        own = bisect_right(borders, p.start)
        upto = places[i + 1].rows if i + 1 < len(places) else p.rows
        if own != shard:
            shard, shard_rows = own, p.rows
        elif upto - last <= most:
            continue
        last = p.rows
        out.append({"start": p.start, "no": len(out), "shard": shard, "slot": p.rows - shard_rows})
    return out


def _with_range(rows: DataFrame, ranges: list[dict]) -> DataFrame:
    """Rows with the range (at) that holds their key, found by their cell: a broadcast of 16 ** CELL rows."""
    kind = "array<struct<start:string,no:int,shard:int,slot:long>>"
    cells = rows.sparkSession.range(16**CELL).select(F.lower(F.lpad(F.hex("id"), CELL, "0")).alias("cell"), F.from_json(F.lit(json.dumps(ranges)), kind).alias("all"))
    before = F.element_at(F.filter("all", lambda r: r["start"] <= F.col("cell")), -1)
    inside = F.filter("all", lambda r: (r["start"] > F.col("cell")) & r["start"].startswith(F.col("cell")))
    cells = cells.select("cell", F.concat(F.array(before), inside).alias("own"))
    j = rows.join(F.broadcast(cells), F.substring("key", 1, CELL) == F.col("cell"))
    return j.withColumn("at", F.element_at(F.filter("own", lambda r: r["start"] <= F.col("key")), -1)).drop("cell", "own")


def shard(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; with carry also row, the row itself.

    Rows come sorted by (shard, slot) inside their range.
    """
    rows = keyed(docs, id_col, text_col, carry)
    first = _count(rows, [], 0, _step(n))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, sum(k for _, k in first.values()) // (4 * max(parts, n)))
    splitters = _splitters(rows, first, n) if first else []
    ranges = _ranges(splitters, _cuts(rows, first, _step(n), most), most)
    out = _with_range(rows, ranges).withColumn("no", F.col("at.no"))
    rank = F.row_number().over(W.partitionBy("no").orderBy("key"))
    out = out.withColumn("slot", F.col("at.slot") + rank - 1)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("at.shard").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows themselves with shard and slot, a folder for each shard; files hold neighbouring slots in order."""
    out = shard(docs, n, id_col, text_col, carry=True)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "shard", "slot").write.partitionBy("shard").parquet(path)

