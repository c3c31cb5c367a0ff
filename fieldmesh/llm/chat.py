"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, from a user's first to an
assistant's last. Dynamic programming over that automaton takes for every turn the cheapest of: keeping its role,
taking another one (RELABEL; UNKNOWN where the role is none of the three), joining the turn before (MERGE), and
an empty turn put before it (INSERT); at the end empty turns close the sequence.

Costs compose like matrices over (min, +), so long conversations need no single task: stretches of CHUNK turn numbers
give 4 x 4 matrices, groups of those are composed level by level, the best states at the borders come back down, and
each stretch is then solved between its own two borders. Stretches that would hold more than CROWDED turns (numbers that
are null, negative or repeated) are sorted over all tasks and cut by rank.

Ties: keeping or relabelling before merging before inserting, then the role that comes first. Defined cases: null
or unknown roles are relabelled; null text is empty; null or negative turn numbers go with the first stretch (nulls first);
turns with one number are ordered by role and text; repeated rows are turns of their own; a null conv_id is a conversation
of its own, whatever the other ids;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("start", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, UNKNOWN, INSERT, RELABEL = 1, 1, 3, 4
#: The empty turns that close a sequence, by its last state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
CHUNK, CROWDED = 256, 1024
_FAR = 1 << 60


def _steps() -> dict[int, list[list[tuple[int, int, str, int]]]]:
    """By the turn's role and the state before: (cost, state after, action, inserted role or 0) in order of preference."""
    out: dict[int, list] = {}
    for role in range(4):
        out[role] = []
        for s in range(4):
            as_ = lambda t, role=role: 0 if t == role else UNKNOWN if role == START else RELABEL
            own = [(as_(t), t, "keep" if t == role else "relabel", 0) for t in NEXT[s]]
            if s != START:
                own.append((MERGE + as_(s), s, "merge", 0))
            own += [(INSERT + as_(t), t, "keep" if t == role else "relabel", x) for x in NEXT[s] for t in NEXT[x]]
            out[role].append(own)
    return out


STEPS = _steps()


def forward(codes: list[int], entry: int) -> tuple[list[int], list[list[tuple | None]]]:
    """(cost of ending in each state, the choices that lead there)."""
    cost = [_FAR] * 4
    cost[entry] = 0
    trace: list[list[tuple | None]] = []
    for c in codes:
        new, back = [_FAR] * 4, [None] * 4
        for s in range(4):
            if cost[s] < _FAR:
                for step in STEPS[c][s]:
                    k = cost[s] + step[0]
                    if k < new[step[1]]:
                        new[step[1]], back[step[1]] = k, (s, step)
        cost = new
        trace.append(back)
    return cost, trace


def best_exit(cost: list[int]) -> int:
    return min(range(4), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), s))


def solve(codes: list[int], entry: int = START, exit_: int | None = None) -> tuple[int, list[tuple[int, int, str, int]], int]:
    """(cost without closing, the step of each turn, the state at the end)."""
    cost, trace = forward(codes, entry)
    end = s = best_exit(cost) if exit_ is None else exit_
    steps = []
    for back in reversed(trace):
        s, step = back[s]
        steps.append(step)
    return cost[end], steps[::-1], end


def _segment(step: tuple, before: int, text: str, closing: bool, end: int) -> str:
    out = ""
    if step[3]:
        out += ("" if before == START else "<|end|>\n") + f"<|{NAMES[step[3]]}|>\n"
        before = step[3]
    out += f"\n{text}" if step[2] == "merge" else ("" if before == START else "<|end|>\n") + f"<|{NAMES[step[1]]}|>\n{text}"
    if closing:
        out += "<|end|>\n" + "".join(f"<|{NAMES[x]}|>\n<|end|>\n" for x in CLOSING[end])
    return out


def _levels(leaves: DataFrame) -> DataFrame:
    """conv_key, part, entry, leave, last for every stretch; one-stretch conversations are left out."""
    kind = "conv_key string, part long, m array<long>"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [[x for e in range(4) for x in forward([t["code"] for t in turns], e)[0]] for turns in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.int64()))], ["conv_key", "part", "m"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(2).to_pylist():
                m = [0 if i == j else _FAR for i in range(4) for j in range(4)]
                for p in parts:
                    m = [min(min(m[4 * i + k] + p["m"][4 * k + j] for k in range(4)), _FAR) for i in range(4) for j in range(4)]
                out.append(m)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv_key", "part", "m"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, parts, entry, leave, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cost = [0 if s == entry else _FAR for s in range(4)]
                back = []
                for p in parts:
                    m = p["m"]
                    pick = [min(range(4), key=lambda k, j=j, cost=cost, m=m: cost[k] + m[4 * k + j]) for j in range(4)]
                    cost = [min(cost[pick[j]] + m[4 * pick[j] + j], _FAR) for j in range(4)]
                    back.append(pick)
                s = leave if leave is not None else best_exit(cost)
                for i in range(len(parts) - 1, -1, -1):
                    rows.append((key, parts[i]["part"], back[i][s], s, last and i == len(parts) - 1))
                    s = back[i][s]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_key", "part", "entry", "leave", "last"])

    many = leaves.groupBy("conv_key").agg(F.count("*").alias("n")).filter("n > 1").select("conv_key")
    m = stage(leaves.join(many, "conv_key", "left_semi").select("conv_key", "part", "turns").mapInArrow(matrices, kind), "matrices")
    stack = []
    while True:
        up = F.floor(F.col("part") / CHUNK).cast("long")
        group = m.groupBy("conv_key", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("parts"))
        stack.append(stage(group, "level"))
        m = stack[-1].select("conv_key", F.col("up").alias("part"), "parts").mapInArrow(composed, kind)
        m = stage(m, "matrices")
        if not m.filter("part > 0").limit(1).count():
            break
    state = m.select("conv_key", "part", F.lit(START).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("last"))
    for group in reversed(stack):
        asked = group.join(state.withColumnRenamed("part", "up"), ["conv_key", "up"]).select("conv_key", "parts", "entry", "leave", "last")
        state = stage(asked.mapInArrow(borders, "conv_key string, part long, entry int, leave int, last boolean"), "borders")
    return state


def _cut_by_rank(rows: DataFrame, crowded: DataFrame, chunk: int) -> DataFrame:
    """The rows, parts renumbered so that crowded ones become parts of at most `chunk` turns in the order of the turns."""
    key = ["conv_key", "part"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rows.join(crowded, key, "left_semi").repartitionByRange(n, *key, "t").sortWithinPartitions(*key, "t")
    # numbers that rise with the order within and across tasks; written, so that they stay
    many = stage(many.withColumn("sub", F.floor(F.monotonically_increasing_id() / F.lit(chunk)).cast("long")), "ranked-turns")
    every = rows.join(crowded, key, "left_anti").withColumn("sub", F.lit(0).cast("long")).unionByName(many)
    # one row for each stretch of the conversations concerned
    stretches = every.join(crowded.select("conv_key").distinct(), "conv_key", "left_semi").select(*key, "sub").distinct()
    order = W.partitionBy("conv_key").orderBy("part", "sub")
    new = stage(stretches.withColumn("new", (F.row_number().over(order) - 1).cast("long")), "stretch-numbers")
    return every.join(new, [*key, "sub"], "left").withColumn("part", F.coalesce("new", "part")).drop("sub", "new")


def format_chats(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per turn: conv_id, turn, seq (order in its stretch), part, role, new_role, action, inserted, cost, closing, rendered.

    A conversation's rendering is the concatenation of its rows' in the order of (part, seq).
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    code = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    code = F.when(code == "system", SYSTEM).when(code == "user", USER).when(code == "assistant", ASSISTANT).otherwise(START)
    part = F.floor(F.greatest(F.coalesce("turn", F.lit(0)), F.lit(0)) / chunk).cast("long")
    # every id has a mark before it, so none is taken for the null one
    conv_key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select("conv_id", conv_key.alias("conv_key"), part.alias("part"), F.struct(F.col("turn").cast("long").alias("turn"), code.alias("code"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sizes = rows.groupBy("conv_key", "part").agg(F.count("*").alias("n"))
    crowded = stage(sizes.filter(F.col("n") > max(CROWDED, chunk)).select("conv_key", "part"), "crowded-stretches")
    if crowded.limit(1).count():
        rows = _cut_by_rank(rows, crowded, chunk)
    leaves = rows.groupBy("conv_key", "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(11)]
            for conv, own_part, own, entry, leave, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = START if entry is None else entry
                _, steps, end = solve([t["code"] for t in own], before, leave)
                for i, (t, step) in enumerate(zip(own, steps, strict=True)):
                    closing = i == len(own) - 1 and last is not False
                    tail = CLOSING[end] if closing else ()
                    row = (conv, t["turn"], own_part, i, t["role"], NAMES[step[1]], step[2], NAMES[step[3]] if step[3] else None, step[0] + INSERT * len(tail), len(tail), _segment(step, before, t["text"], closing, end))
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                    before = step[1]
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["conv_id", "turn", "part", "seq", "role", "new_role", "action", "inserted", "cost", "closing", "rendered"])

    if rows.filter("part > 0").limit(1).count():
        leaves = stage(leaves, "stretches")
        leaves = leaves.join(_levels(leaves), ["conv_key", "part"], "left").select("conv_id", "part", "turns", "entry", "leave", "last")
    else:
        none = F.lit(None)
        leaves = leaves.select("conv_id", "part", "turns", none.cast("int").alias("entry"), none.cast("int").alias("leave"), none.cast("boolean").alias("last"))
    schema = f"conv_id {kind}, turn long, part long, seq int, role string, new_role string, action string, inserted string, cost int, closing int, rendered string"
    return leaves.mapInArrow(run, schema)
