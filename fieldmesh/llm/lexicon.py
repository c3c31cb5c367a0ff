"""BPE encoding and decoding through a minimal acyclic transducer.

The words that most documents use are compiled into an automaton whose states share suffixes as well as
prefixes. Every transition carries the number of words that its state accepts by earlier ones; summed along a path
this is the word's index in the output table, which holds the word's token ids. The arrays are saved as one .npy
file, sent to every executor once, and memory-mapped there. A batch's distinct words run through it together;
words outside it are merged exactly, by the vocabulary's ranks, many words a step. Texts themselves are cut at ASCII
white space and put together again by Arrow; a task remembers what each cut piece gave for as long as it keeps coming.

Defined cases: null text is empty and has no tokens; special strings get their ids; bytes that are no UTF-8 count as
U+FFFD; rows repeat as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, text_or_empty

#: Words compiled into the automaton: the most frequent ones of the corpus.
LEXICON_WORDS = 131072
MEMO = 300_000
NO_RANK = 1 << 60
#: The vocabulary's white space without the six ASCII characters, which cut texts already.
_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Ranks, ids and patterns of a word-end BPE file, and exact merging."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.special_cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"[^\s\p{L}\p{N}]", rf"[^ \t\n\r\x0b\x0c{_SPACE}\p{{L}}\p{{N}}]"))
        # the printable stand-ins of bytes, by the rule of byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        # the same as numbers: ids of bytes inside and at the end of words, and a hash table of the pairs that merge
        get = lambda x: self.ids.get(x, -1)
        self.inner = np.array([get(self.stand_in[b]) for b in range(256)], np.int64)
        self.last = np.array([get(self.stand_in[b] + self.end) for b in range(256)], np.int64)
        pairs = [(get(a), get(b), get(a + b), r) for (a, b), r in self.ranks.items()]
        self.numbered = min(self.inner.min(), self.last.min(), min((min(p) for p in pairs), default=0)) >= 0
        self.merged = np.zeros(len(pairs) + 1, np.int64)
        self.slots = np.full(1 << max(8, (4 * len(pairs)).bit_length()), -1, np.int64)
        self.slot_rank = np.zeros(len(self.slots), np.int64)
        key = np.array([a << 32 | b for a, b, _, _ in pairs], np.int64) if self.numbered else np.zeros(0, np.int64)
        rank = np.array([r for *_, r in pairs], np.int64)[: len(key)]
        self.merged[rank] = [m for *_, m, _ in pairs][: len(key)]
        at, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.slots[at[placed]], self.slot_rank[at[placed]] = key[placed], rank[placed]
            left = np.ones(len(key), bool)
            left[placed] = False
            key, rank, at = key[left], rank[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NO_RANK for pairs that do not merge, and where an id is -1."""
        out = np.full(a.shape, NO_RANK)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        key = a.ravel()[todo] << 32 | b.ravel()[todo]
        at = self._slot(key)
        flat = out.reshape(-1)
        for _ in range(self.probes):
            held = self.slots[at]
            hit = held == key
            flat[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (held >= 0)
            todo, key, at = todo[go], key[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word: in every step all words merge their lowest-ranked pair, the leftmost of equals."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[list[int]] = [[] for _ in words]
        for lo, hi in ((1, 8), (9, 16), (17, 32), (33, 64)):
            own = np.flatnonzero((length >= lo) & (length <= hi)) if self.numbered else []
            for a in range(0, len(own), 20_000):
                self._merge_rows(own[a : a + 20_000], [raw[i] for i in own[a : a + 20_000].tolist()], hi, out)
        for i in np.flatnonzero(length > (64 if self.numbered else 0)).tolist():
            out[i] = self.merge(words[i])
        return out

    def _merge_rows(self, own: np.ndarray, raw: list[bytes], width: int, out: list[list[int]]) -> None:
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), length)
        end = np.cumsum(length)
        ids = self.inner[flat]
        ids[end - 1] = self.last[flat[end - 1]]
        s = np.full((len(raw), width + 1), -1, np.int64)  # the last column stays empty
        s[row, np.arange(len(flat)) - (end - length)[row]] = ids
        r = np.concatenate([self.pair_ranks(s[:, :-1], s[:, 1:]), np.full((len(raw), 1), NO_RANK)], 1)
        cols = np.arange(width + 1)
        while len(s):
            best = r.argmin(1)
            rank = r[np.arange(len(r)), best]
            stop = rank == NO_RANK
            if stop.any():
                for i, ids in zip(own[stop].tolist(), s[stop].tolist(), strict=True):
                    out[i] = ids[: ids.index(-1)]
                s, r, own, best, rank = (x[~stop] for x in (s, r, own, best, rank))
            if not len(s):
                break
            at = np.arange(len(s))
            s[at, best] = self.merged[rank]
            right = cols[None, :-1] > best[:, None]
            s[:, :-1] = np.where(right, s[:, 1:], s[:, :-1])
            r[:, :-1] = np.where(right, r[:, 1:], r[:, :-1])
            before = np.maximum(best - 1, 0)
            r[at, best] = self.pair_ranks(s[at, best], s[at, best + 1])
            r[at, before] = np.where(best > 0, self.pair_ranks(s[at, before], s[at, before + 1]), r[at, before])

    def words(self, piece: str) -> list[str]:
        """The normalised words of a piece without ASCII white space."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            # lower-cased character by character: a final sigma is an ordinary one
            piece = piece.lower() if "Σ" not in piece else "".join(c.lower() for c in piece)
        else:
            piece = piece.lower()
            if piece.isalpha():
                return [piece]
        return self.pattern.findall(piece)

    def merge(self, word: str) -> list[int]:
        """Token ids of one word: the lowest-ranked pair is merged until none is left."""
        parts = [self.stand_in[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        rank, none = self.ranks.get, 1 << 60
        if len(parts) > 400:
            parts = self._merge_long(parts)
        order = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), none)
        return [self.ids[p] for p in parts if p in self.ids]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap over a linked list, for very long words."""
        n, rank = len(parts), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or rank((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (q, x))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]


def build_automaton(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal automaton of the words, with each word's ids at its index in byte order."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges_of: list[tuple] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(node[0])
            edges_of.append(key[1])
        return state

    path: list[list] = [[False, []]]  # the open nodes along the last word: final?, settled edges
    labels: list[int] = []
    for word in words:
        common = 0
        while common < len(labels) and common < len(word) and labels[common] == word[common]:
            common += 1
        while len(labels) > common:
            state = settle(path.pop())
            path[-1][1].append((labels.pop(), state))
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        state = settle(path.pop())
        path[-1][1].append((labels.pop(), state))
    root = settle(path.pop())
    accepted = np.zeros(len(finals), np.int64)  # states are numbered children first
    keys, to, skip = [], [], []
    for s, edges in enumerate(edges_of):
        n = int(finals[s])
        for byte, t in edges:
            keys.append(s << 8 | byte)
            to.append(t)
            skip.append(n)
            n += int(accepted[t])
        accepted[s] = n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [entries[w] for w in words]
    return {
        "keys": np.array(keys, np.int64)[order],
        "to": np.array(to, np.int64)[order],
        "skip": np.array(skip, np.int64)[order],
        "final": np.array(finals, np.int64),
        "root": np.array([root], np.int64),
        "offset": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.int64),
    }


PARTS = ("keys", "to", "skip", "final", "root", "offset", "ids")


def save_automaton(parts: dict[str, np.ndarray], path: str) -> None:
    """One file: the lengths of the parts, then the parts."""
    np.save(path, np.concatenate([np.array([len(parts[p]) for p in PARTS], np.int64), *(parts[p] for p in PARTS)]))


class Automaton:
    def __init__(self, path: str):
        flat = np.load(path, mmap_mode="r").view(np.ndarray)
        at = len(PARTS)
        for name, n in zip(PARTS, flat[:at].tolist(), strict=True):
            setattr(self, name, flat[at : at + n])
            at += n

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The words' indexes; -1 for words outside."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        state = np.full(n, self.root[0], np.int64)
        index = np.zeros(n, np.int64)
        live = np.flatnonzero(lengths > 0)
        state[lengths == 0] = -1
        for i in range(int(lengths.max())):
            live = live[lengths[live] > i]
            if not len(live):
                break
            key = state[live] << 8 | flat[first[live] + i]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            state[live[~ok]] = -1
            live, edge = live[ok], edge[ok]
            state[live] = self.to[edge]
            index[live] += self.skip[edge]
        good = state >= 0
        good[good] = self.final[state[good]] == 1
        return np.where(good, index, -1)

    def outputs(self, index: np.ndarray) -> list[list[int]]:
        """The ids at the indexes, which are not -1."""
        lo, n = self.offset[index], self.offset[index + 1] - self.offset[index]
        end = np.cumsum(n)
        flat = self.ids[np.arange(n.sum()) + np.repeat(lo - end + n, n)].tolist()
        return [flat[b - k : b] for b, k in zip(end.tolist(), n.tolist(), strict=True)]


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the texts' pieces between ASCII white space, one after another; where each text's start)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, at = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return (flat, at) if full.all() else (flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at])


class Encoder:
    """Ids and decoded text of whole texts, for one task."""

    def __init__(self, vocabulary: Vocabulary, automaton: Automaton):
        self.vocabulary, self.automaton = vocabulary, automaton
        self.specials = {x.encode(): (1, str(i), x) for x, i in vocabulary.specials.items()}
        #: piece -> (its number of ids, its ids joined, its decoded text); what has not come since `shown` was last full is forgotten
        self.shown: dict[bytes, tuple[int, str, str]] = {}
        self.before: dict[bytes, tuple[int, str, str]] = {}

    def learn(self, pieces: set[bytes]) -> None:
        """Encode the pieces that are new: distinct words through the automaton, the rest by merging."""
        if len(self.shown) > MEMO // 2:
            self.before, self.shown = self.shown, {}
        shown, before = self.shown, self.before
        fresh = pieces.difference(shown)
        again = fresh.intersection(before)
        shown.update((p, before[p]) for p in again)
        new = list(fresh - again)
        split = [self.vocabulary.words(p.decode("utf-8", "replace")) for p in new]
        ids = self.word_ids(list({w for ws in split for w in ws}))
        token = self.vocabulary.tokens
        for p, ws in zip(new, split, strict=True):
            own = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            shown[p] = (len(own), " ".join(map(str, own)), self.decode(own, token))

    def word_ids(self, words: list[str]) -> dict[str, list[int]]:
        found = self.automaton.lookup([w.encode("utf-8", "surrogatepass") for w in words])
        at = np.flatnonzero(found >= 0)
        ids = dict(zip([words[i] for i in at.tolist()], self.automaton.outputs(found[at]), strict=True))
        rest = [words[i] for i in np.flatnonzero(found < 0).tolist()]
        ids.update(zip(rest, self.vocabulary.merge_many(rest), strict=True))
        return ids

    @staticmethod
    def decode(ids: list[int], token: dict[int, str]) -> str:
        """The file names no decoder: tokens stand side by side, parted by a space."""
        return " ".join([token[i] for i in ids])

    def special_pieces(self, text: bytes) -> list[bytes]:
        """The pieces of a text in which special strings stand; they are pieces of their own."""
        parts = self.vocabulary.special_cut.split(text.decode("utf-8", "replace"))
        return [p for part in parts for p in ([part.encode()] if part in self.vocabulary.specials else part.encode().split())]

    def run(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, ids joined by a space, decoded text) of each text."""
        special = np.zeros(len(texts), bool)
        for x in self.specials:
            special |= pc.match_substring(texts, x.decode()).to_numpy(zero_copy_only=False)
        flat, at = _pieces(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        coded = flat.dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
        if special.any():  # their pieces go in between
            rows = np.flatnonzero(special)
            own = [self.special_pieces(texts[i].as_py().encode()) for i in rows.tolist()]
            number = {p: i for i, p in enumerate(names)}
            extra = [np.array([number.setdefault(p, len(number)) for p in ps], np.int64) for ps in own]
            names = list(number)
            size = np.diff(at)
            cuts = np.split(code, at[1:-1])
            for i, e in zip(rows.tolist(), extra, strict=True):
                cuts[i], size[i] = e, len(e)
            code, at = np.concatenate(cuts), np.concatenate([[0], np.cumsum(size)])
        self.learn(set(names) - self.specials.keys())
        self.shown.update(self.specials)
        got = [self.shown[p] for p in names]
        n = np.array([g[0] for g in got], np.int64)
        if len(n) and not n.all():  # pieces without any id leave nothing to join
            full = n[code] > 0
            at = np.concatenate([[0], np.cumsum(full)])[at]
            code = code[full]
        take, offsets = pa.array(code), pa.array(at.astype(np.int32))
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([g[k] for g in got], pa.string()).take(take)), " ") for k in (1, 2)]
        total = np.concatenate([[0], np.cumsum(n[code])])
        return total[at[1:]] - total[at[:-1]], joined[0], joined[1]


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", top: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of the whole corpus, at most `top` of them; counted per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        v, seen = Vocabulary(path), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for piece, n in seen.items():
                if n > 1:
                    for w in v.words(piece.decode("utf-8", "replace")):
                        words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in small(batches, 0):
            found = _pieces(b.column(0))[0].value_counts()
            for piece, n in zip(found.field(0).cast(pa.binary()).to_pylist(), found.field(1).to_pylist(), strict=True):
                seen[piece] += n
            if len(seen) > 2 * MEMO:
                yield flush()
        yield flush()

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, n long")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    rows = total.orderBy(F.desc("n"), "word").limit(top).select("word").collect()  # `top` rows at most
    return [r[0] for r in rows]


#: Folders of shipped files, removed when the driver ends.
_SHIPPED: list[tempfile.TemporaryDirectory] = []


def ship_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    """Compile the words, send the file to all executors, and give its name there."""
    v = Vocabulary(path)
    words = [w for w in words if w]
    parts = build_automaton(dict(zip([w.encode("utf-8", "surrogatepass") for w in words], v.merge_many(words), strict=True)))
    name = f"lexicon-{uuid.uuid4().hex}.npy"  # two shipped files never share a name
    _SHIPPED.append(tempfile.TemporaryDirectory(prefix="spark-"))
    local = os.path.join(_SHIPPED[-1].name, name)
    save_automaton(parts, local)
    spark.sparkContext.addFile(local)
    return name


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", top: int = LEXICON_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_text adds the ids and the decoded text."""
    name = ship_lexicon(docs.sparkSession, frequent_words(docs, path, text_col, top), path)
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    sha = lambda texts: pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(Vocabulary(path), Automaton(SparkFiles.get(name)))
        for b in small(batches, 1):
            n, ids, decoded = e.run(b.column(1))
            cols, names = [b.column(0), pa.array(n), sha(ids), sha(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                cols += [pa.array([[int(i) for i in x.split()] for x in ids.to_pylist()], pa.list_(pa.int32())), decoded]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<int>, decoded string" if with_text else ""
    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
