"""Token counts with a public byte-level BPE vocabulary.

A token of this kind never spans a change from a non-space character to a white-space one: no alternative of the
pre-tokenising pattern matches a non-space followed by a space, and its only lookahead is inside runs of spaces.
So such a place is a stable boundary, whatever stands on either side. It serves twice:

* Within a text, the pieces between stable boundaries are encoded apart and their counts remembered, so the
  library sees each distinct piece of a task once.
* Huge texts are cut into overlapping chunks in one pass, and tasks share the chunks. Every chunk is encoded by itself and
  gives, for the overlaps at its ends, the boundaries it found with their offsets and the tokens before them.
  Neighbouring chunks are spliced at the first boundary that both have; texts with an overlap without one are
  encoded again with a wider overlap, the last time whole.

Defined cases: null text is empty and has 0 tokens; special strings in a text are handled as the library does by
default; rows repeat as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stage, text_or_empty

CHUNK, OVERLAP = 65536, 512
#: Bytes of distinct pieces, with their entries, that a task remembers, about; an entry beside its piece.
MEMO_BYTES, ENTRY = 64 << 20, 150
_PIECE = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+")
#: White space that the pattern knows besides the six ASCII characters, and what Python and the pattern treat differently.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class PieceCounter:
    """Token counts of whole texts, by pieces."""

    def __init__(self, encode_batch: Callable[[list[str]], list[int]], specials: tuple[str, ...] = ()):
        self.encode_batch, self.memo, self.held = encode_batch, {}, 0
        # a special string is found before the pattern runs; it must lie within one piece
        self.specials = tuple(s for s in specials if re.search(r"\s", s))

    def pieces(self, text: str) -> list[str]:
        if _OTHER_SPACE.search(text) or any(s in text for s in self.specials):
            return [text] if text else []
        found = _PIECE.findall(text)
        tail = len(text) - len(text.rstrip(" \t\n\r\x0b\x0c"))
        if tail:
            found.append(text[len(text) - tail :])
        return found

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        size = sum(map(len, new)) + ENTRY * len(new)
        if self.held + size > MEMO_BYTES and self.memo:
            self.memo.clear()
            new = list(pieces)
            self.held, size = 0, sum(map(len, new)) + ENTRY * len(new)
        self.held += size
        self.memo.update(zip(new, self.encode_batch(new), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        need: set[str] = set()
        for s in split:
            need.update(s)
        self.learn(need)
        get = self.memo.__getitem__
        return [sum(map(get, s)) for s in split]


def library_counter(path: str) -> PieceCounter:
    """For a vocabulary file of the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return PieceCounter(
        lambda batch: [len(e.ids) for e in tok.encode_batch_fast(batch, add_special_tokens=False)],
        tuple(t.content for t in tok.get_added_tokens_decoder().values()),
    )


def _ends(counter: PieceCounter, text: str, left: int, right: int) -> tuple[int, list, list]:
    """Tokens of a chunk, and (offset, tokens before it) of the boundaries in its first `left` and last `right` characters."""
    pieces = counter.pieces(text)
    counter.learn(set(pieces))
    n = np.fromiter(map(counter.memo.__getitem__, pieces), np.int64, len(pieces))
    at = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    before = np.cumsum(n)
    # a boundary lies behind each piece but the last, which the chunk's end may have cut
    at, before = at[:-1], before[:-1]
    pick = lambda m: [{"off": int(o), "n": int(k)} for o, k in zip(at[m], before[m], strict=True)]
    return int(n.sum()), pick(at <= left) if left else [], pick(at >= len(text) - right) if right else []


def _chunk_counts(chunks: DataFrame, counter: Callable[[], PieceCounter]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter()
        cut = pa.list_(pa.struct([("off", pa.int64()), ("n", pa.int64())]))
        for b in batches:
            rows = b.to_pylist()
            got = [_ends(c, r["piece"], r["left"], r["right"]) for r in rows]
            lo = [[{"off": x["off"] + r["start"], "n": x["n"]} for x in g[1]] for r, g in zip(rows, got, strict=True)]
            hi = [[{"off": x["off"] + r["start"], "n": x["n"]} for x in g[2]] for r, g in zip(rows, got, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array(lo, cut), pa.array(hi, cut)],
                ["row_key", "k", "tokens", "lo", "hi"],
            )

    return chunks.mapInArrow(run, "row_key string, k long, tokens long, lo array<struct<off:long,n:long>>, hi array<struct<off:long,n:long>>")


#: Characters of chunks that leave a task at a time, about.
_OUT = 2 << 20


def chunks_of(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row_key, k, start, piece, left, right): every text's chunks, cut in one pass; left and right are the overlaps at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["row_key", "k", "start", "piece", "left", "right"])

        for b in small(batches, 1):
            for key, text in zip(b.column(0), b.column(1), strict=True):
                name, whole = key.as_py(), text.as_py()
                parts = max(1, -(-(len(whole) - overlap) // chunk))
                for k in range(parts):
                    last = k == parts - 1
                    piece = whole[k * chunk :] if last else whole[k * chunk : (k + 1) * chunk + overlap]
                    rows.append((name, k, k * chunk, piece, overlap if k else 0, 0 if last else overlap))
                    held += len(piece)
                    if held > _OUT:
                        yield flush()
                        rows, held = [], 0
        yield flush()

    return huge.select("row_key", "text").mapInArrow(run, "row_key string, k long, start long, piece string, left int, right int")


def _spliced(huge: DataFrame, counter: Callable[[], PieceCounter], chunk: int, overlap: int) -> DataFrame:
    """row_key, n_tokens; null where two chunks share no boundary."""
    cut = chunks_of(huge, chunk, overlap)
    got = _chunk_counts(cut.repartition("row_key", "k"), counter)
    w = W.partitionBy("row_key").orderBy("k")
    got = got.withColumn("next_lo", F.lead("lo").over(w))
    common = F.array_min(F.array_intersect(F.expr("transform(hi, x -> x.off)"), F.expr("transform(next_lo, x -> x.off)")))
    got = got.withColumn("splice", common).withColumn("prev", F.lag("splice").over(w)).withColumn("is_last", F.col("next_lo").isNull())
    upto = F.when(F.col("is_last"), F.col("tokens")).otherwise(F.expr("get(filter(hi, x -> x.off = splice), 0).n"))
    since = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.expr("get(filter(lo, x -> x.off = prev), 0).n"))
    got = got.withColumn("own", upto - since)
    return got.groupBy("row_key").agg(F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    counter: Callable[[str], PieceCounter] = library_counter,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    make = lambda: counter(path)
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    long_text = F.length("text") > chunk
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = make()
        for b in small(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.counts(b.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = base.filter(~long_text).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    short = short.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    # equal texts of equal rows have equal counts, so the text's digest names the work
    huge = base.filter(long_text).withColumn("row_key", F.sha2("text", 256))
    n_huge = huge.select(F.count("*"), F.max(F.length("text"))).first()
    done = None
    if n_huge[0]:
        todo = huge.select("row_key", "text").dropDuplicates(["row_key"])
        while True:
            got = stage(_spliced(todo, make, chunk, overlap), "spliced")
            ok = got.filter("n_tokens IS NOT NULL")
            done = ok if done is None else done.unionByName(ok)
            if overlap >= n_huge[1] or got.count() == ok.count():
                break
            todo = todo.join(got.filter("n_tokens IS NULL").select("row_key"), "row_key", "left_semi")
            overlap *= 8
            chunk = max(chunk, 2 * overlap)
        more = huge.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("n_bytes")).join(done, "row_key")
        short = short.unionByName(more.select("doc_id", "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens")))
    return short.withColumn("over_limit", F.col("n_tokens") > limit)
