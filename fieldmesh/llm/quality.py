"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once; the ledger row of a document has its measurements and one bit per failed rule.
A policy is a named version: the set of rules it enforces. Applying one is a bitwise AND, and an ablation
(what would be kept without rule r) is a count over the distinct masks, so neither reads a text again.

The measurements come from an Arrow task: the words of a whole batch are numbered together and the 8-word
windows are compared as rows of word numbers (sorted by a hash, equal hashes confirmed on the words).

Defined cases: null or empty text has no words and fails the base; rows repeat as they come; an empty table
gives an empty ledger; the operator reads the id and text columns only, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small, stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")
#: In the order of their bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "long_words": "n_words > 0 AND word_chars > 15 * n_words",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "shouting": "100 * n_bangs > 50 * n_words",
}
#: Versions of the policy: the rules each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}


def policy_mask(version: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in POLICIES[version])


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words covered by windows of WINDOW words that occur twice or more in their document."""
    n = len(ids)
    out = np.zeros(n_docs, np.int64)
    if n < WINDOW:
        return out
    starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(starts):
        return out
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = doc[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(WINDOW):
        h = (h ^ mixed[starts + j]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s, hs = starts[order], h[order]
    same = np.flatnonzero(hs[1:] == hs[:-1])
    if not len(same):
        return out
    a, b = s[same], s[same + 1]
    equal = doc[a] == doc[b]
    for j in range(WINDOW):
        equal &= ids[a + j] == ids[b + j]
    if not equal.all():  # two windows share a hash: settle the batch on the words themselves
        rows = np.ascontiguousarray(np.column_stack([doc[starts], *(ids[starts + j] for j in range(WINDOW))]))
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hit = starts[counts[inverse.ravel()] > 1]
    else:
        hit = np.unique(np.concatenate([a, b]))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The measurements of a batch of texts."""
    n_docs = len(texts)
    out = {m: np.zeros(n_docs, np.int64) for m in MEASURES}
    words: list[bytes] = []
    lengths = np.zeros(n_docs, np.int64)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        own = raw.split()
        lengths[i] = len(own)
        words += own
        joined = b"".join(own)
        out["word_chars"][i] = len(joined.decode("utf-8", "surrogatepass"))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        out["n_bangs"][i] = raw.count(b"! ") + raw.count(b"!\n") + raw.endswith(b"!")
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    out["n_words"] = lengths
    if words:
        ids = pd.factorize(np.array(words, object))[0]
        out["n_repeat_words"] = _repeat_words(ids, np.repeat(np.arange(n_docs), lengths), n_docs)
    return out


def failure_bits() -> Column:
    """One bit for each failed rule, from the measurements' columns."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and the failure bits of every row."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            got = measure(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    kind = ids.schema["doc_id"].dataType.simpleString()
    measured = ids.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failed_bits", failure_bits())


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """The ledger with kept: no rule of the version failed."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of the version: documents that fail it, and those that no other rule of it would drop."""
    mask = policy_mask(version)
    masks = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if mask >> i & 1))
    each = masks.select("m", "n", F.explode(rules).alias("r"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_regained"),
    )


def ablation_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(version, rule, n_failed, n_regained, n_kept) of every policy, from a ledger that is written once: no text is read again."""
    entries, out = stage(ledger(docs, id_col, text_col), "ledger"), None
    for version in POLICIES:
        kept = apply_policy(entries, version).agg(F.count_if("kept").alias("n_kept"))
        # one row
        part = ablations(entries, version).withColumn("version", F.lit(version)).join(F.broadcast(kept), F.lit(True))
        out = part if out is None else out.unionByName(part)
    return out.select("version", "rule", "n_failed", "n_regained", "n_kept")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: str = "v2") -> DataFrame:
    """The ledger under a policy, with base_failed; kept is false wherever the base fails."""
    out = apply_policy(ledger(docs, id_col, text_col), version)
    base = F.col("failed_bits").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed_bits",
    )


def keep_good(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that pass, in one pass: the measurements ride along with the row."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            got = measure(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[m]) for m in MEASURES)], ["row", *MEASURES])

    schema = StructType([packed.schema["row"], *(StructField(m, LongType()) for m in MEASURES)])
    measured = packed.mapInArrow(run, schema)
    mask = policy_mask(version) | policy_mask("base")
    return measured.filter(failure_bits().bitwiseAND(F.lit(mask).cast("long")) == 0).select("row.*")
