"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a row of tokens: its words, then an end. Each token is coded in binary decisions. The first CLASS_BITS of them
name its class: the OWN most frequent words (the end among them) are classes of their own, the other words share
classes by their first two bytes, cut so that the classes have equal mass. Within a class a known word has its
share of the training counts; an unknown one has the share of the class's words that came once, times the
probability of its spelling, eight decisions a byte.

Every decision is predicted from hashed slots that count zeros and ones: for classes after the class before, the two
classes before and the word before; for spellings after one, two and three bytes and the word so far. For classes a match
predictor is added: the word that followed when this text last had the same two words. The stretched predictions are
weighted and summed; a gate (length of the match, counts of the last context) selects the weights. A refinement map
corrects what the mix says by what came of it. Probabilities multiply; bits per byte follow.

1. Tasks cut texts into words and pack them as blocks: word numbers and the block's distinct words.
2. Words are counted over the training texts of all blocks; class borders and masses follow from the counts.
3. Spelling is learnt online over the distinct training words, and words that only other texts have are spelt.
4. Blocks get their words' counts back (one row for each block and word).
5. Classes are learnt online, block after block, in a seeded order of documents: each batch is predicted from what came
   before it, then moves the weights, fills the refinement map, and is counted. Tasks' states merge by sums (weights by
   their decisions), piece by piece in tasks; the table's size is fixed by SLOTS.
6. Texts are scored from the merged state, and weights go on adapting within each text, from its start to its end, so a
   score depends on the text and the model only.

Defined cases: null text is empty and consists of its end; a null doc_id is held out (as the crc32 of the empty text
is 0); rows that repeat a doc_id are all scored and all count in training; with no training text N and V are 0
and every base term is log10(0.1 / 0.1); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small, stage, text_or_empty

CLASS_BITS, OWN = 7, 64
CLASSES = 1 << CLASS_BITS
#: log2 of the slots: class contexts (one class, two classes, a word's hash), spelling contexts (1, 2, 3 bytes, the word so far).
SLOTS = (2 * CLASS_BITS, 3 * CLASS_BITS, 21)
SPELL_SLOTS = (16, 18, 20, 20)
#: Text in a block; tokens that are laid out as arrays at a time (a longer text stands alone).
BLOCK_BYTES, SLICE = 24 << 20, 1 << 17
#: Tokens, and bytes of words, whose decisions are worked on at a time: few enough for the processor's caches.
CHUNK, SPELL_CHUNK = 2048, 8192
#: Longer words are spelt in pieces; one of full length is followed by another.
SPELL_PIECE = 256
PIECE = 1 << 16
CONF, RUNS, CELLS = 8, 9, 33
RATE, SLOWER, OWN_RATE, FIRST_STEP = 0.15, 60.0, 0.02, 32
END = b"\n"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_CLASS = np.arange(CLASSES)[:, None]
_LEVEL = np.arange(CLASS_BITS)[None, :]
#: The node at which each decision of a class is taken, and the bit that comes.
NODE = (CLASSES | _CLASS) >> (CLASS_BITS - _LEVEL)
BIT = (_CLASS >> (CLASS_BITS - 1 - _LEVEL) & 1).astype(np.int8)
PULL = BIT * np.float32(4) - np.float32(2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    return x ^ (x >> np.uint64(27))


def _starts(slots: tuple[int, ...]) -> np.ndarray:
    return np.cumsum([0, *(1 << s for s in slots)])


def _confidence(seen: np.ndarray) -> np.ndarray:
    """The magnitude of what a context has seen: the exponent of a float32."""
    return np.minimum(((seen + np.float32(1)).view(np.int32) >> 23) - 127, CONF - 1).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cells(mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The refinement cell below a stretched prediction, and how far it is on the way to the next one."""
    x = (np.clip(mix, np.float32(-8), np.float32(8)) + np.float32(8)) * np.float32((CELLS - 1) / 16)
    lo = np.minimum(x.astype(np.int64), CELLS - 2)
    return lo, x - lo.astype(np.float32)


def _stretched(counts: np.ndarray) -> np.ndarray:
    """log(ones / zeros) of (..., 2) counts."""
    both = np.log(counts + np.float32(0.2))
    return both[..., 1] - both[..., 0]


def _weighed(weights: np.ndarray, gate: np.ndarray, inputs: list[np.ndarray], moved: np.ndarray | None = None) -> np.ndarray:
    """The gated sum of the inputs; moved: by input and text, what is added to the weights."""
    mix = np.zeros(gate.shape, np.float32)
    for k, x in enumerate(inputs):
        w = weights[k][gate]
        if moved is not None:
            w += moved[k][:, None]
        w *= x
        mix += w
    return np.clip(mix, np.float32(-12), np.float32(12), out=mix)


class Learner:
    """Slot counts, gated weights and refinement map of one task, learnt online."""

    def __init__(self, slots: tuple[int, ...], inputs: int, groups: int):
        self.counts = np.zeros((int(_starts(slots)[-1]), 2), np.float32)
        self.pairs = self.counts.view(np.int64).ravel()  # a slot's two counts as one item
        self.weights = np.full((inputs, groups * CONF), 0.4, np.float32)
        self.seen = np.zeros(groups * CONF)
        self.refined = np.zeros((groups, CELLS, 2))
        self.hits = np.zeros((RUNS, 2))
        self.step = 0

    def learn(self, slots: list[np.ndarray], extra: np.ndarray | None, group: np.ndarray, bit: np.ndarray) -> None:
        """Predict a batch of decisions from what came before, then learn from it; all of one shape, group by rows."""
        gates = len(self.seen)
        inputs = []
        for s in slots:
            c = self.pairs[s].view(np.float32).reshape(*s.shape, 2)
            inputs.append(_stretched(c))
        gate = group[:, None] * CONF + _confidence(c[..., 0] + c[..., 1])
        if extra is not None:
            inputs.append(extra)
        mix = _weighed(self.weights, gate, inputs)
        error = bit - _sigmoid(mix)
        flat = gate.ravel()
        n = np.bincount(flat, minlength=gates)
        rate = RATE / (1 + self.step / SLOWER) / np.maximum(n, 32)
        for k, x in enumerate(inputs):
            self.weights[k] += rate * np.bincount(flat, (error * x).ravel(), gates)
        self.seen += n
        self.step += 1
        lo, part = _cells(mix)
        at = ((group[:, None] * CELLS + lo) * 2 + bit).ravel()
        part = part.ravel()
        size = self.refined.size
        self.refined += (np.bincount(at, 1 - part, size) + np.bincount(at + 2, part, size)[:size]).reshape(self.refined.shape)
        flat, one = self.counts.reshape(-1), np.float32(1)
        for s in slots:
            np.add.at(flat, (s * 2 + bit).ravel(), one)

    def state(self) -> Iterator[pa.RecordBatch]:
        """Rows (piece, where, what): the slots that are not empty, and under piece -1 the rest."""
        rest = np.concatenate([(self.weights * self.seen).ravel(), self.seen, self.refined.ravel(), self.hits.ravel()])
        yield _state_row(-1, np.zeros(0, np.uint16), rest.astype(np.float64))
        for i in range(0, len(self.counts), PIECE):
            part = self.counts[i : i + PIECE]
            where = np.flatnonzero(part.any(1))
            if len(where):
                yield _state_row(i // PIECE, where.astype(np.uint16), part[where])


_STATE = "piece int, at binary, what binary"


def _squeezed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed: shuffles carry less."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _opened(raw: bytes | pa.Buffer, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _state_row(piece: int, at: np.ndarray, what: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([_squeezed(at)], pa.binary()), pa.array([_squeezed(what)], pa.binary())], ["piece", "at", "what"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the states' pieces; rows come sorted by piece, so one piece is held at a time."""
    now, total = None, None

    def done() -> pa.RecordBatch:
        if now == -1:
            return _state_row(-1, np.zeros(0, np.uint16), total)
        where = np.flatnonzero(total.any(1))
        return _state_row(now, where.astype(np.uint16), total[where].astype(np.float32))

    for b in batches:
        for piece, at, what in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if piece != now:
                if now is not None:
                    yield done()
                now, total = piece, None
            if piece == -1:
                x = _opened(what, np.float64)
                total = x.copy() if total is None else total + x
            else:
                total = np.zeros((PIECE, 2)) if total is None else total
                total[_opened(at, np.uint16)] += _opened(what, np.float32).reshape(-1, 2)
    if now is not None:
        yield done()


@dataclass
class Model:
    """What scoring needs: stretched slots, the last context's confidence, weights, refinement map, match rates."""

    stretch: np.ndarray
    confidence: np.ndarray
    weights: np.ndarray
    refined: np.ndarray
    hit: np.ndarray

    def predict(self, slots: list[np.ndarray], extra: np.ndarray | None, group: np.ndarray, moved: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(probability of a one, stretched inputs), with group and moved (by input) for each row of decisions."""
        inputs = [self.stretch[s] for s in slots]
        gate = group[:, None] * CONF + self.confidence[slots[-1] - (len(self.stretch) - len(self.confidence))]
        if extra is not None:
            inputs.append(extra)
        mix = _weighed(self.weights, gate, inputs, moved)
        lo, part = _cells(mix)
        flat = self.refined.reshape(-1)
        at = group[:, None] * CELLS + lo
        below = flat[at]
        p = np.float32(0.5) * (_sigmoid(mix) + below + (flat[at + 1] - below) * part)
        return np.clip(p, np.float32(2.0**-18), np.float32(1 - 2.0**-18), out=p), inputs


def merged_model(states: DataFrame, slots: tuple[int, ...], inputs: int, groups: int) -> Model:
    """Adds the tasks' states up in tasks, piece by piece; the driver gets one stretched number for each slot (fixed by SLOTS)."""
    n = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = stage(states.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(_merged, _STATE), "model")
    total, last, gates = int(_starts(slots)[-1]), 1 << slots[-1], groups * CONF
    stretch, conf = np.zeros(total, np.float32), np.zeros(last, np.uint8)
    rest = np.zeros(gates * inputs + gates + groups * CELLS * 2 + RUNS * 2)
    for r in added.toLocalIterator():
        if r["piece"] < 0:
            rest = _opened(r["what"], np.float64).copy()
            continue
        at = _opened(r["at"], np.uint16).astype(np.int64) + r["piece"] * PIECE
        c = _opened(r["what"], np.float32).reshape(-1, 2)
        stretch[at] = _stretched(c)
        own = at >= total - last
        conf[at[own] - (total - last)] = _confidence(c[own].sum(1))
    release(added)
    w, seen, refined, hits = np.split(rest, np.cumsum([gates * inputs, gates, groups * CELLS * 2]))
    weights = np.where(seen > 0, w.reshape(inputs, gates) / np.maximum(seen, 1), 0.4).astype(np.float32)
    prior = _sigmoid(np.linspace(-8, 8, CELLS))
    refined = refined.reshape(groups, CELLS, 2) + 8 * np.stack([1 - prior, prior], -1)
    hits = hits.reshape(RUNS, 2) + 0.5
    return Model(stretch, conf, weights, (refined[..., 1] / refined.sum(-1)).astype(np.float32), hits[:, 1] / hits.sum(1))


# --- spelling -----------------------------------------------------------------------------------------------------


def spelling_pieces(word: bytes) -> list[bytes]:
    return [word[i : i + SPELL_PIECE] for i in range(0, len(word) + 1, SPELL_PIECE)]


def spelling(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(slots of the four predictors and the bit, eight for a byte; the word of each byte) of spelling words and a closing space."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n) + 1
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.uint64)
    first = np.cumsum(length) - length
    word = np.repeat(np.arange(n), length)
    at = np.arange(len(flat)) - first[word]
    shift = lambda k: np.where(at >= k, np.concatenate([np.zeros(k, np.uint64), flat[:-k]])[: len(flat)], np.uint64(0))
    o1 = shift(1)
    o2 = o1 | shift(2) << np.uint64(8)
    o3 = o2 | shift(3) << np.uint64(16)
    # the word so far: a hash carried from byte to byte, all words in step
    prefix = np.zeros(len(flat), np.uint64)
    state = np.zeros(n, np.uint64)
    live = np.arange(n)
    for i in range(int(length.max()) if n else 0):
        live = live[length[live] > i]
        where = first[live] + i
        prefix[where] = state[live]
        state[live] = _mix((state[live] ^ (flat[where] + np.uint64(1))) * _M[0])
    bits = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << bits)[None, :] | flat[:, None] >> (np.uint64(8) - bits)[None, :]
    bit = (flat[:, None] >> (np.uint64(7) - bits)[None, :] & np.uint64(1)).astype(np.int8)
    start = _starts(SPELL_SLOTS)
    slots = [(o1[:, None] << np.uint64(8) | node).astype(np.int64)]
    for k, ctx in ((1, o2), (2, o3), (3, prefix)):
        h = ((ctx[:, None] + np.uint64(k)) * _M[0] ^ node * _M[2]) * _M[1]
        slots.append((h >> np.uint64(64 - SPELL_SLOTS[k])).astype(np.int64) + start[k])
    return slots, bit, word


def _spelling_chunks(words: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Pieces of a bounded number of bytes, with the words they belong to."""
    held, own, size = [], [], 0
    for i, w in enumerate(words):
        for p in spelling_pieces(w):
            held.append(p)
            own.append(i)
            size += len(p) + 1
            if size >= SPELL_CHUNK:
                yield held, own
                held, own, size = [], [], 0
    if held:
        yield held, own


def spelling_bits(model: Model, words: list[bytes]) -> np.ndarray:
    """log2 of the probability of each word's spelling."""
    out = np.zeros(len(words))
    for pieces, own in _spelling_chunks(words):
        slots, bit, piece = spelling(pieces)
        p, _ = model.predict(slots, None, np.zeros(len(bit), np.int64))
        gain = np.bincount(piece, np.log2(1 - np.abs(bit - p)).sum(1), len(pieces))
        np.add.at(out, own, gain)
    return out


def _learn_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = Learner(SPELL_SLOTS, len(SPELL_SLOTS), 1)
    for b in batches:
        for pieces, _ in _spelling_chunks(b.column(0).to_pylist()):
            slots, bit, _ = spelling(pieces)
            m.learn(slots, None, np.zeros(len(bit), np.int64), bit)
    yield from m.state()


# --- classes ------------------------------------------------------------------------------------------------------


@dataclass
class Classes:
    """The words with classes of their own, the class of each two first bytes, and the classes' masses."""

    own: list[bytes]
    of_prefix: np.ndarray
    mass: np.ndarray
    once: np.ndarray

    def of(self, words: pa.Array) -> np.ndarray:
        n = len(words)
        words = words.cast(pa.large_binary())
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        raw = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.int64)
        second = np.where(at[1:] - at[:-1] > 1, raw[at[:-1] + 1], 0)
        cls = self.of_prefix[raw[at[:-1]] << 8 | second]
        own = pc.index_in(words, value_set=pa.array(self.own, pa.large_binary())).fill_null(-1).to_numpy()
        return np.where(own >= 0, own, cls)


def make_classes(counts: DataFrame) -> Classes:
    """From (word, c): at most OWN words and 65,536 sums over two first bytes come to the driver."""
    known = counts.filter("c > 0")
    top = [bytes(r["word"]) for r in known.filter(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(OWN - 1).select("word").collect()]
    own = [END, *sorted(top)]
    prefix = F.conv(F.rpad(F.hex(F.expr("substring(word, 1, 2)")), 4, "0"), 16, 10).cast("int")
    name = F.when(F.col("word").isin([F.lit(w) for w in own]), F.col("word"))
    sums = known.groupBy(prefix.alias("prefix"), name.alias("own")).agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect()
    mass, once = np.zeros(CLASSES), np.zeros(CLASSES)
    of_prefix, rare = np.zeros(65536), np.zeros(65536)
    for r in sums:
        if r["own"] is None:
            of_prefix[r["prefix"]] += r["c"]
            rare[r["prefix"]] += r["once"]
        else:
            mass[own.index(bytes(r["own"]))] += r["c"]
    upto = np.cumsum(of_prefix) - of_prefix / 2
    cls = OWN + np.minimum(upto * (CLASSES - OWN) / max(upto[-1], 1) if len(sums) else upto, CLASSES - OWN - 1).astype(np.int64)
    mass += np.bincount(cls, of_prefix, CLASSES)
    once += np.bincount(cls, rare, CLASSES)
    once[OWN:] += 0.5  # a class without words that came once may still meet an unknown one
    return Classes(own, cls, mass, once)


def matches(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the predicted word or -1, run) of every token; texts start at `first`.

    Predicted is what followed the last time this text had the two words before; run is 0 without a prediction, else
    1 and the predictions in a row that came true just before, up to RUNS - 1.
    """
    n = len(ids)
    place, run = np.full(n, -1), np.zeros(n, np.int64)
    if n < 3:
        return place, run
    doc = np.zeros(n, np.uint64)
    doc[first[first < n]] = 1
    np.cumsum(doc, out=doc)
    same = np.flatnonzero(doc[2:] == doc[:-2]) + 2
    # a hash of (text, two words) above the place: sorted, equal contexts follow one another in the order of their places
    at = np.uint64(n.bit_length())
    key = _mix((ids[same - 2].astype(np.uint64) * _M[2] ^ _mix(ids[same - 1].astype(np.uint64) + doc[same] * _M[1]) + doc[same]) * _M[0])
    by = (np.sort(key << at | same.astype(np.uint64)) & ((np.uint64(1) << at) - np.uint64(1))).astype(np.int64)
    a, b = by[:-1], by[1:]
    again = (ids[a - 2] == ids[b - 2]) & (ids[a - 1] == ids[b - 1]) & (doc[a] == doc[b])
    place[b[again]] = a[again]
    hit = (place >= 0) & (ids == ids[np.maximum(place, 0)])
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(hit, -1, at))  # hits in a row, this one included
    before = np.concatenate([[0], since[:-1]])
    run = np.where(place >= 0, 1 + np.minimum(before, RUNS - 2), 0)
    return place, run


@dataclass
class Tokens:
    """The tokens of several texts as arrays: classes, contexts, predicted classes and runs."""

    cls: np.ndarray
    one: np.ndarray
    two: np.ndarray
    word: np.ndarray
    guess: np.ndarray
    run: np.ndarray
    hit: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, first: np.ndarray, cls_of: np.ndarray, hash_of: np.ndarray) -> Tokens:
        cls, h = cls_of[ids].astype(np.int64), hash_of[ids].astype(np.int64)
        back = lambda x, k, none: np.concatenate([np.full(k, none, x.dtype), x[:-k]])[: len(x)]
        c1, c2, w1 = back(cls, 1, 0), back(cls, 2, 0), back(h, 1, 0)
        first = first[first < len(ids)]
        c1[first], c2[first], w1[first] = 0, 0, 0
        c2[(first + 1)[first + 1 < len(ids)]] = 0
        place, run = matches(ids, first)
        guess = np.where(place >= 0, cls[np.maximum(place, 0)], -1)
        hit = (place >= 0) & (ids == ids[np.maximum(place, 0)])
        start = _starts(SLOTS)
        word = (w1 & ((1 << (SLOTS[2] - CLASS_BITS)) - 1)) << CLASS_BITS
        return Tokens(cls, c1 << CLASS_BITS, ((c2 << CLASS_BITS | c1) << CLASS_BITS) + start[1], word + start[2], guess, run, hit)

    def decisions(self, at: np.ndarray | slice) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(slots, match input, group, bit) of the tokens at the places; a row of CLASS_BITS for each."""
        cls, guess = self.cls[at], self.guess[at]
        node, bit = NODE[cls], BIT[cls]
        slots = [c[at][:, None] + node for c in (self.one, self.two, self.word)]
        extra = np.zeros(node.shape, np.float32)
        told = np.flatnonzero(guess >= 0)
        extra[told] = np.where(NODE[guess[told]] == node[told], PULL[guess[told]], np.float32(0))
        return slots, extra, self.run[at], bit


def learn_classes(m: Learner, t: Tokens) -> None:
    for a in range(0, len(t.cls), CHUNK):
        slots, extra, group, bit = t.decisions(slice(a, a + CHUNK))
        m.learn(slots, extra, group, bit)
    told = (t.guess >= 0) & (t.guess == t.cls)
    m.hits += np.bincount(t.run[told] * 2 + t.hit[told], minlength=2 * RUNS).reshape(RUNS, 2)


def class_bits(model: Model, t: Tokens, first: np.ndarray) -> np.ndarray:
    """log2 of the probability of each token's class; the weights of every text adapt as it goes on.

    A text's tokens come in steps, the first of FIRST_STEP tokens, each next one as long as all before; after each step
    the text's weights move along its gradient.
    """
    n, texts = len(t.cls), len(first)
    doc = np.repeat(np.arange(texts), np.diff(np.append(first, n)))
    pos = np.arange(n) - first[doc]
    level = np.where(pos < FIRST_STEP, 0, np.log2(np.maximum(pos, 1) / FIRST_STEP).astype(np.int64) + 1)
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    moved = np.zeros((len(model.weights), texts), np.float32)
    out = np.zeros(n)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        pull = np.zeros(moved.shape)
        for a in range(lo, hi, CHUNK):
            at = order[a : min(a + CHUNK, hi)]
            own = doc[at]
            slots, extra, group, bit = t.decisions(at)
            p, inputs = model.predict(slots, extra, group, moved[:, own])
            error = bit - p
            came = 1 - np.abs(error)
            whole = came[:, 0].astype(np.float64)
            for j in range(1, CLASS_BITS):
                whole *= came[:, j]
            out[at] = np.log2(whole)
            if hi < n:
                for k, x in enumerate(inputs):
                    pull[k] += np.bincount(own, np.einsum("nj,nj->n", error, x), texts)
        if hi < n:
            moved += OWN_RATE * pull / np.sqrt(1.0 + np.bincount(doc[order[lo:hi]], minlength=texts)) / CLASS_BITS
    return out


def text_bits(model: Model, ids: np.ndarray, first: np.ndarray, cls_of: np.ndarray, hash_of: np.ndarray, tail_of: np.ndarray) -> np.ndarray:
    """log2 of each token's probability: its class, whether it is the predicted word, and its share within the class."""
    t = Tokens.of(ids, first, cls_of, hash_of)
    bits = class_bits(model, t, first)
    told = (t.guess >= 0) & (t.guess == t.cls)
    p = model.hit[t.run]
    return bits + np.where(told, np.where(t.hit, np.log2(p), np.log2(1 - p) + tail_of[ids]), tail_of[ids])


# --- blocks -------------------------------------------------------------------------------------------------------


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers with an end behind each text, where texts start, the distinct words); number 0 is the end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, at = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        at = np.concatenate([[0], np.cumsum(full)])[at]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    n = len(texts)
    ids = np.zeros(len(flat) + n, np.int32)
    ends = at[1:] + np.arange(n)
    word = np.ones(len(ids), bool)
    word[ends] = False
    ids[word] = coded.indices.to_numpy() + 1
    return ids, at[:-1] + np.arange(n), pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.binary())])


def _slices(size: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(texts, tokens) of runs of whole texts with about SLICE tokens each, from the texts' sizes."""
    end = np.cumsum(size)
    part = (end - size) // SLICE
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(size) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(size)], strict=True):
        yield slice(lo, hi), slice(int(end[lo] - size[lo]), int(end[hi - 1]))


def _array(batch: pa.RecordBatch, column: str, row: int, dtype: type) -> np.ndarray:
    """The bytes of a row as an array, without a copy."""
    return np.frombuffer(batch.column(column)[row].as_buffer(), dtype)


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all the values."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack_blocks(base: DataFrame) -> DataFrame:
    """A row for each block of texts: its documents in a seeded order, their tokens, its words and their training counts."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows, [("order", "ascending")]))
        texts = rows.column("text").combine_chunks()
        ids, first, words = cut_words(texts)
        size = np.diff(np.append(first, len(ids)))
        train = ~rows.column("held_out").to_numpy()
        n = np.bincount(ids[np.repeat(train, size)], minlength=len(words))
        lists = (rows.column("doc_id"), rows.column("held_out"), pc.binary_length(texts).cast(pa.int64()), pa.array(size), words, pa.array(n))
        cols = [pa.array([number], pa.int64()), *map(_list, lists), pa.array([_squeezed(ids)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["block", "doc_id", "held_out", "n_bytes", "n_tokens", "words", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in small(batches, 2):
            held.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield block(number, pa.Table.from_batches(held))
                number, held, size = number + 1, [], 0
        if size:
            yield block(number, pa.Table.from_batches(held))

    schema = f"block long, doc_id array<{kind}>, held_out array<boolean>, n_bytes array<long>, n_tokens array<long>, words array<binary>, n array<long>, ids binary"
    return base.mapInArrow(run, schema)


def _training(classes: Classes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Learner(SLOTS, len(SLOTS) + 1, RUNS)
        for b in batches:
            for i in range(b.num_rows):
                ids, (cls, h) = _opened(b.column("ids")[i].as_buffer(), np.int32), (_array(b, c, i, t) for c, t in (("cls", np.uint8), ("hash", np.uint32)))
                size, held = b.column("n_tokens")[i].values.to_numpy(), b.column("held_out")[i].values.to_numpy(zero_copy_only=False)
                for texts, tokens in _slices(size):
                    own, train = size[texts], ~held[texts]
                    if train.any():
                        some, own = ids[tokens][np.repeat(train, own)], own[train]
                        learn_classes(m, Tokens.of(some, np.cumsum(own) - own, cls, h))
        yield from m.state()

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    base = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("order", F.xxhash64("doc_id", F.lit(10)))
    kind = base.schema["doc_id"].dataType.simpleString()
    blocks = stage(pack_blocks(base), "blocks", "zstd")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    counts = stage(words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    n_train, n_distinct = counts.filter("c > 0").select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes = make_classes(counts)

    # the end has a class of its own and is never spelt
    learnt = counts.filter((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word").mapInArrow(_learn_spelling, _STATE)
    speller = spark.sparkContext.broadcast(merged_model(learnt, SPELL_SLOTS, len(SPELL_SLOTS), 1))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = spelling_bits(speller.value, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits)], ["word", "spelt"])

    unknown = stage(counts.filter("c = 0").select("word").mapInArrow(spell, "word binary, spelt double"), "unknown-words")
    speller.destroy()
    unit = float(n_train) + 0.1 * (n_distinct + 1)

    def attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """look: the word's hash and class; value: its training count, or the log2 of its spelling's probability (below 0)."""
        for b in batches:
            look = b.column(1).to_numpy() << CLASS_BITS | classes.of(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(look), b.column(2)], ["word", "look", "value"])

    value = counts.filter("c > 0").select("word", F.col("c").cast("double").alias("value")).unionByName(unknown.select("word", F.col("spelt").alias("value")))
    rated = value.select("word", F.pmod(F.xxhash64("word", F.lit(7)), F.lit(1 << 31)).alias("h"), "value").mapInArrow(attributes, "word binary, look long, value double")

    def pack(t: pa.Table) -> pa.Table:
        """One block's words as arrays in the order of their numbers."""
        t = t.take(pc.sort_indices(t, [("at", "ascending")]))
        look = t.column("look").to_numpy()
        cols = [(look & (CLASSES - 1)).astype(np.uint8).tobytes(), (look >> CLASS_BITS).astype(np.uint32).tobytes(), _squeezed(t.column("value").to_numpy())]
        return pa.table([t.column("block").slice(0, 1), *(pa.array([x], pa.binary()) for x in cols)], ["block", "cls", "hash", "value"])

    # one row for each block and word: a frequent word has as many as there are blocks, and AQE splits a skewed join
    noted = words.select("block", "at", "word").join(rated, "word").drop("word")
    packed = noted.groupBy("block").applyInArrow(pack, "block long, cls binary, hash binary, value binary")
    coded = stage(blocks.drop("words", "n").join(packed, "block"), "coded", "zstd")
    for t in (blocks, counts, unknown):
        release(t)
    states = coded.select("held_out", "n_tokens", "ids", "cls", "hash").mapInArrow(_training(classes), _STATE)
    shared = spark.sparkContext.broadcast(merged_model(states, SLOTS, len(SLOTS) + 1, RUNS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        for b in batches:
            for i in range(b.num_rows):
                size, n_bytes = b.column("n_tokens")[i].values.to_numpy(), b.column("n_bytes")[i].values.to_numpy()
                every = _opened(b.column("ids")[i].as_buffer(), np.int32)
                cls, h, value = _array(b, "cls", i, np.uint8), _array(b, "hash", i, np.uint32), _opened(b.column("value")[i].as_buffer(), np.float64)
                c, spelt = np.maximum(value, 0), np.minimum(value, 0)
                whole = np.maximum(classes.mass[cls] + classes.once[cls], 1e-9)
                tail = np.log2(np.maximum(np.where(c > 0, c, classes.once[cls]), 1e-9) / whole) + spelt
                base_of, known_of = np.log10((c + 0.1) / unit), c > 0
                for texts, tokens in _slices(size):
                    own, ids = size[texts], every[tokens]
                    first = np.cumsum(own) - own
                    bits, base, known = (np.add.reduceat(x, first) for x in (text_bits(shared.value, ids, first, cls, h, tail), base_of[ids], known_of[ids].astype(np.int64)))
                    raw = n_bytes[texts]
                    cols = [b.column(c)[i].values[texts] for c in ("doc_id", "held_out")]
                    cols += [pa.array(own), pa.array(known), pa.array(np.full(len(own), int(n_train))), pa.array(base), pa.array(bits * np.log10(2.0))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(-bits / np.maximum(raw, 1), mask=raw == 0)], names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return coded.mapInArrow(score, schema)
