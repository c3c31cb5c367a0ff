"""The training-data operators against brute force, exact round trips and the tokenizers library."""

import hashlib
import itertools
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldmesh.llm import chat, context_mixing, exact_dedup, lexicon, mixing, near_dedup, quality, suffix_dedup, tokens, warc
from fieldmesh.llm.components import Forest

P = pytest.importorskip("public_tokenizers")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], DOCS)
    return df.withColumn("key", F.lit(1)).withColumn("n", F.lit("x")).withColumn("size", F.lit(2)).repartition(4)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = ["der", "Édu", "the", "a", "#x", "café", "ΟΔΟΣ", "it's", "1234"] + [f"w{i}" for i in range(300)]
    rows = [None, "", " ", "a", "A", "a" * 3000, "ab " * 200, "x\ty", "x y", "<|endoftext|> a<|startoftext|>b", "line\nline\nline\nq", "no-space" * 3000]
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(rng.choice([" ", "  ", "\n"]).join(own))
    return [(i, t, rng.choice(["s1", "s2", "s3", None])) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    for out in (
        suffix_dedup.suffix_dedup(empty), exact_dedup.exact_dedup(empty), tokens.token_counts(empty, byte), lexicon.encode(empty, word),
        quality.quality(empty), near_dedup.near_components(empty), mixing.mix(empty), context_mixing.score_texts(empty),
        chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def brute_suffix(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each distinct (doc_id, text), in the order given."""
    seen, out = set(), []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("classes", [8192, 3])
def test_suffix_dedup(spark, corpus, monkeypatch, classes):
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    monkeypatch.setattr(suffix_dedup, "RANGE", 500)
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30_000))
    rows = [*corpus, (10_000, long, "s"), (10_001, "x" + long[20_000:90_000] + "y" + long[:300], "s")]
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == brute_suffix([(d, t) for d, t, _ in sorted(rows, key=lambda r: r[0])])


def test_suffix_dedup_without_hits_and_with_odd_ids(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = text(80)
    docs = [(i, text(200) + shared + text(200), None) for i in range(3)]  # an 80-byte passage repeats nothing
    assert [r["n_removed"] for r in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()] == [0, 0, 0]
    a, b = text(900), text(150)
    # a null id comes last, rows that repeat id and text are one document, and each loses the same
    docs = [(7, a, None), (7, b, None), (7, a, None), (None, a + b, None), (None, a + b, None), (9, b + a, None)]
    got = [tuple(r)[:3] for r in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted([(7, 900, 0), (7, 900, 0), (7, 150, 0), (None, 1050, 1050), (None, 1050, 1050), (9, 1050, 1050)], key=str)


def test_suffix_dedup_takes_string_ids(spark):
    rows = [(f"k{d}", t) for d, t in enumerate(["a" * 150, "b" * 120, "c" + "a" * 130])]
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == brute_suffix(rows)


def test_deep_shallow_orders_all_windows():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(97, 99, 900).astype(np.uint8), np.full(300, 97, np.uint8), np.tile(np.arange(5, dtype=np.uint8), 80)])
    at = np.arange(len(buf) - 99)
    order, group = suffix_dedup.deep_shallow(buf, at)
    windows = [buf[i : i + 100].tobytes() for i in at[order]]
    assert windows == sorted(windows)
    assert all((windows[i] == windows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(windows)))


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(spark, corpus, collide):
    from pyspark.sql import functions as F

    rows = corpus + corpus[:3]
    key = (lambda c: F.length(c) % 3 + F.lit(0).cast("long")) if collide else F.xxhash64
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(d)
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows), key=key, capacity=8).collect())
    expected = sorted((d, min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert got == expected


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("shuffled", [False, True])
def test_exact_dedup_slices_hot_keys(spark, monkeypatch, collide, shuffled):
    """A text that a third of the rows have goes to many owners, with broadcasts and without; no owner gets more than a bucket's capacity."""
    from pyspark.sql import functions as F

    from fieldmesh.llm import common

    if shuffled:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    written = {}

    def kept(df, tag):
        written[tag] = df.select(*df.columns).collect() if tag == "hash-index" else []
        return common.stage(df, tag)

    monkeypatch.setattr(exact_dedup, "stage", kept)
    rows = [(i, "hot  text" if i % 2 else "hot text", "x") for i in range(0, 400)] + [(1000 + i, f"t {i % 500}", "x") for i in range(800)]
    key = (lambda c: F.length(c).cast("long")) if collide else F.xxhash64
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows), key=key, capacity=64).collect())
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[SPACE.sub(" ", t)].append(d)
    assert got == sorted((d, min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    if not collide:
        index = written["hash-index"]
        assert len({r["key"] for r in index}) == 501 and len({r["bucket"] for r in index}) > 10
        load = Counter((r["bucket"], r["slice"]) for r in index)
        assert max(load.values()) <= 96 and len([k for k in load if k[1]]) > 20


def test_exact_dedup_keeps_rows_without_ids_and_drops_repeats(spark):
    rows = [(None, "a  b", "x"), (None, "a b", "y"), (None, "c", "x"), (3, "d", "x"), (3, "d", "x"), (3, "e", "x"), (2, "e ", "x"), (None, "e ", "z"), (None, None, "x")]
    got = exact_dedup.drop_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(SPACE.sub(" ", r["text"] or "") for r in got) == ["", "a b", "c", "d", "e "] or sorted((r["text"] or "").strip() for r in got) == ["", "a b", "c", "d", "e", "e"]
    assert {r["doc_id"] for r in got if (r["text"] or "") == "e "} == {2} and sum(r["doc_id"] is None for r in got) == 3


def test_directory_splits_past_one_step(spark):
    """Buckets of the directory are key ranges that hold at most the capacity, whatever the number of bits it takes."""
    keys = spark.createDataFrame([(k << 20,) for k in range(300)] + [(-1 - k,) for k in range(40)], "key long")
    steps = exact_dedup.directory(keys, 7, 8)
    rows = exact_dedup.with_bucket(keys, steps, 8).collect()
    assert len(steps) > 1
    load, unsigned = Counter(r["bucket"] for r in rows), lambda x: x % (1 << 64)
    assert max(load.values()) <= 7 and all(unsigned(r["bucket"]) <= unsigned(r["key"]) for r in rows)
    lows = sorted(map(unsigned, load))
    for r in rows:
        assert max(x for x in lows if x <= unsigned(r["key"])) == unsigned(r["bucket"])


def test_chat_null_conversation_is_no_other(spark):
    """A null id, the empty one and "\\0" are three conversations, with clashing extra columns beside them."""
    rows = [(c, 0, "user", f"{c!r}", "k", 1) for c in (None, "", "\0", "=", "a")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, conv_key string, part int")
    got = chat.format_chats(df).collect()
    assert sorted(repr(r["conv_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
    assert all(r["action"] == "keep" and r["closing"] == 1 and repr(r["conv_id"]) in r["rendered"] for r in got)


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = {d: (len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _ in corpus}
    for chunk, overlap in ((65536, 512), (300, 40)):
        got = {r["doc_id"]: tuple(r)[1:] for r in tokens.token_counts(frame(spark, corpus), P.path("byte_bpe_50k.json"), chunk=chunk, overlap=overlap).collect()}
        assert got == expected


def test_bpe_lexicon(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for d, t, _ in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected[d] = (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: tuple(r)[1:] for r in lexicon.encode(frame(spark, corpus), P.path("word_bpe_49k.json"), top=40).collect()}
    assert got == expected


def test_automaton_shares_suffixes(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "balking"])}
    parts = lexicon.build_automaton(words)
    lexicon.save_automaton(parts, str(tmp_path / "a.npy"))
    a = lexicon.Automaton(str(tmp_path / "a.npy"))
    assert len(parts["final"]) < sum(map(len, words)) / 2
    found = a.lookup([*words, b"walk", b"", b"talkings"])
    assert a.outputs(found[:5]) == list(words.values()) and found[5:].tolist() == [-1, -1, -1]


def test_quality_rules(spark, corpus):
    expected = {}
    for d, t, _ in corpus:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = defaultdict(list)
        for i in range(len(ws) - 7):
            grams[tuple(ws[i : i + 8])].append(i)
        rep = {i + j for g in grams.values() if len(g) > 1 for i in g for j in range(8)}
        fail = len(ws) < 20 or 100 * len(rep) > 30 * len(ws)
        expected[d] = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), fail)
    df = quality.quality(frame(spark, corpus))
    rows = df.collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == expected
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)
    entries = quality.ledger(frame(spark, corpus))
    kept = quality.apply_policy(entries, "v2").filter("kept").count()
    ab = {r["rule"]: r for r in quality.ablations(entries, "v2").collect()}
    own = [r["failed_bits"] for r in entries.collect()]
    assert ab["few_words"]["n_regained"] == sum(b == 1 for b in own) and kept == sum(b == 0 for b in own)
    assert {r["doc_id"] for r in quality.keep_good(frame(spark, corpus)).collect()} == {r["doc_id"] for r in rows if r["kept"]}


@pytest.mark.parametrize(("block", "sets"), [(2048, 512), (8, 6)])
def test_near_dedup(spark, corpus, monkeypatch, block, sets):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", sets)
    shingles = {}
    for d, t, _ in corpus:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        shingles[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    forest = Forest()
    for a, b in itertools.combinations(shingles, 2):
        both = len(shingles[a] & shingles[b])
        if both and 100 * both >= 80 * len(shingles[a] | shingles[b]):
            forest.join(a, b)
    expected = {d: (len(s), forest.find(d), forest.find(d) == d) for d, s in shingles.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_components(frame(spark, corpus), 4).collect()} == expected


def test_near_dedup_with_odd_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base, "x"), ("a", base + " end", "x"), (None, base + " other", "x"), ("c", "quite another text of six words", "x"), (None, "alone it stands here with words", "x"), ("c", base, "x"), ("c", base, "x"), ("d", None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = sorted(((r["doc_id"] or "~", r["component_id"] or "~", r["kept"]) for r in near_dedup.near_components(df).collect()))
    assert got == [("a", "a", True), ("b", "a", False), ("c", "a", False), ("c", "a", False), ("c", "c", True), ("d", "d", True), ("~", "a", False), ("~", "~", True)]
    left = near_dedup.drop_near_duplicates(df).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["None", "a", "c", "d"]


def test_large_components_are_whole(spark, monkeypatch):
    """Chains and stars of more classes than a block: what only far members join stays joined."""
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):  # each text differs from the last in a word: a chain whose ends share little
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words), None))
    got = {r["component_id"] for r in near_dedup.near_components(frame(spark, rows), 1).collect()}
    sets = [set(t.split()) for _, t, _ in rows]
    forest = Forest()
    for a, b in itertools.combinations(range(60), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            forest.join(a, b)
    assert got == {forest.find(i) for i in range(60)}


def test_joint_estimate_follows_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.0, 0.5, 0.9):
        b = np.concatenate([a[: int(4000 * share)], rng.integers(0, 1 << 63, 4000 - int(4000 * share)).astype(np.uint64)])
        sig = near_dedup.registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 4000, 8000]))
        est = near_dedup.joint_estimate(np.array([(sig[0] > sig[1]).sum()]), np.array([(sig[0] < sig[1]).sum()]), 4000, np.array([4000]))[0]
        assert est == pytest.approx(share / (2 - share), abs=0.15)


def test_mixing(spark, corpus):
    rows = corpus + [(10_000 + i, "w " * (i % 50), "hot") for i in range(400)]
    got = [r.asDict() for r in mixing.mix(frame(spark, rows)).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _, _ in rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:  # clamp, share the rest, again
        rest = 1.5 * total - sum(2 * size[s] for s in capped)
        level = rest / max(1, sum(w[s] for s in w if s not in capped))
        over = {s for s in w if s not in capped and level * w[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    goal = {s: 2 * size[s] if s in capped else level * w[s] for s in w}
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 3000 for s in w)


def test_mixed_takes_rows_one_by_one(spark, corpus):
    rows = [*corpus, (None, "no id " * 9, "s1"), (7, "again " * 30, "s2"), (7, "again " * 30, "s2")]
    df = frame(spark, rows)
    times = Counter()
    for r in mixing.mix(df).collect():
        times[r["doc_id"], r["size"]] += r["repeats"]
    got = Counter()
    for r in mixing.mixed(df).collect():
        got[r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))] += 1
    assert got == +times


def test_chat_with_crowded_stretches(spark, monkeypatch):
    """Null, negative and repeated turn numbers: cut by rank, the cost and the rendering are those of one stretch."""
    rng = random.Random(2)
    rows = [("hot", rng.choice([None, -1, 3, 3]), rng.choice(["user", "assistant", "system", None]), f"t{i}") for i in range(400)] + [("b", i, "user", "x") for i in range(9)] + [(None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    seen = []
    for crowded, chunk in ((10_000, 256), (16, 16)):
        monkeypatch.setattr(chat, "CROWDED", crowded)
        out = defaultdict(lambda: [0, ""])
        for r in sorted(chat.format_chats(df, chunk).collect(), key=lambda r: (str(r["conv_id"]), r["part"], r["seq"])):
            out[r["conv_id"]][0] += r["cost"]
            out[r["conv_id"]][1] += r["rendered"]
        seen.append({k: (c, sorted(re.findall(r"t\d+", t))) for k, (c, t) in out.items()})
    assert seen[0] == seen[1] and len(seen[0]["hot"][1]) == 400


def test_chat_repair(spark):
    def brute(codes):
        best = [10**9]

        def go(i, s, c):
            if c >= best[0]:
                return
            if i == len(codes):
                best[0] = min(best[0], c + chat.INSERT * len(chat.CLOSING[s]))
                return
            cost = lambda t: 0 if t == codes[i] else 1 if codes[i] == 0 else 4
            for t in chat.NEXT[s]:
                go(i + 1, t, c + cost(t))
            if s:
                go(i + 1, s, c + 1 + cost(s))
            for x in chat.NEXT[s]:
                for t in chat.NEXT[x]:
                    go(i + 1, t, c + 3 + cost(t))

        go(0, 0, 0)
        return best[0]

    for codes in itertools.chain.from_iterable(itertools.product(range(4), repeat=n) for n in range(5)):
        c, _, end = chat.solve(list(codes))
        assert c + chat.INSERT * len(chat.CLOSING[end]) == brute(codes)
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([None, "", f"{c}-{t}"])) for c in range(12) for t in range(rng.choice([1, 3, 60]))]
    df = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string")
    cost = []
    for chunk in (256, 3):
        out = chat.format_chats(df, chunk).collect()
        assert len(out) == df.count()
        own = defaultdict(int)
        text = defaultdict(str)
        for r in sorted(out, key=lambda r: (r["conv_id"], r["part"], r["seq"])):
            own[r["conv_id"]] += r["cost"]
            text[r["conv_id"]] += r["rendered"]
        cost.append(own)
        for t in text.values():
            roles = re.findall(r"<\|(system|user|assistant)\|>", t)
            roles = roles[1:] if roles[0] == "system" else roles
            assert roles == ["user", "assistant"] * (len(roles) // 2)
    assert cost[0] == cost[1]


def test_warc(spark):
    pages = [(i, "http://x\n" if i % 3 else None, h) for i, h in enumerate([None, "", "a" * 100, "a" * 100, "b" * 50, "b" * 50, "é" * 80, "é" * 80, "x" * 300_000, "\x1f\x8b\x08WARC/1.0\r\n" * 50] + [f"page {i} " * 30 for i in range(200)] * 2)]
    first, expected = {}, {}
    for i, _, h in pages:
        b = (h or "").encode()
        f = first.setdefault(b, i) if len(b) >= 100 else i
        expected[i] = (i, len(b), hashlib.sha256(b).hexdigest(), "response" if f == i else "revisit", None if f == i else f)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for split in (1 << 20, 700):
        assert {r["page_id"]: tuple(r) for r in warc.round_trip(df, split).collect()} == expected


def test_warc_ids_and_urls_of_any_kind(spark):
    rows = [("b%0D", "http://x/%0D%25\r\n", "p" * 120), ("a", None, "p" * 120), ("", "", "q" * 120), (None, "u", "r")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {"b%0D": ("revisit", "a"), "a": ("response", None), "": ("response", None), None: ("response", None)}
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    read = warc.read_warc(spark, warc.write_warc(df, folder), folder)
    assert {r["page_id"]: r["url"] for r in read.collect()} == {i: u for i, u, _ in rows}


def test_damaged_archives_are_errors(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefgh", k=900))) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    manifest = warc.write_warc(df, folder)
    warc.check_complete(warc.read_warc(spark, manifest, folder), manifest)
    path = manifest.filter("n_records > 0").first()["path"]
    with open(path, "r+b") as f:
        f.seek(5000)
        two = f.read(2)
        f.seek(5000)
        f.write(bytes(255 - b for b in two))
    with pytest.raises(Exception, match="records can be read|does not match its digest"):
        warc.check_complete(warc.read_warc(spark, manifest, folder), manifest)
    lone = spark.createDataFrame([("f", "7", "revisit", "3", None, "d")], "path string, page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
    with pytest.raises(Exception, match="no response for the revisit of page 7"):
        warc.resolved(lone, "long").collect()


def test_huge_texts_are_cut_in_one_pass(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else " é"[i % 2] for i in range(5000))
    df = spark.createDataFrame([("k", text), ("s", "ab")], "row_key string, text string")
    got = sorted((r["row_key"], r["k"], r["start"], r["piece"], r["left"], r["right"]) for r in tokens.chunks_of(df, 300, 40).collect())
    n = 17
    want = [("k", k, k * 300, text[k * 300 :] if k == n - 1 else text[k * 300 : k * 300 + 340], 40 if k else 0, 0 if k == n - 1 else 40) for k in range(n)]
    assert got == [*want, ("s", 0, 0, "ab", 0, 0)]


def test_piece_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 4000)
    counter = tokens.PieceCounter(lambda batch: [len(p) for p in batch])
    for k in range(50):
        words = [f" {k}-{i}" + "x" * 40 for i in range(5)]
        assert counter.counts(["".join(words)]) == [sum(map(len, words))]
        assert sum(map(len, counter.memo)) + tokens.ENTRY * len(counter.memo) <= max(4000, counter.held) <= 4000 or len(counter.memo) <= 5


def test_warc_with_repeated_and_null_ids(spark):
    a, b, short = "x" * 150, "y" * 400, "z"
    rows = [(1, "u", a), (1, "u", b), (2, "u", b), (3, "u", a), (None, "u", a), (None, None, "n" * 200), (None, None, "n" * 200), (4, "u", short), (4, "u", short)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first", "3 AS payload")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    full = [("1", 150, sha(a), "response", None), ("1", 400, sha(b), "response", None), ("2", 400, sha(b), "revisit", 1), ("3", 150, sha(a), "revisit", 1), ("None", 150, sha(a), "revisit", 1)]
    full += [("None", 200, sha("n" * 200), "response", None)] * 2 + [("4", 1, sha(short), "response", None)] * 2
    assert got == sorted(full)


def test_context_mixing(spark, corpus):
    rows = [*corpus, (None, "a null id", None), (5, "a repeated id", None)]
    got = defaultdict(list)
    for r in context_mixing.score_texts(frame(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    count, own = Counter(), defaultdict(list)
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 10 == 0
    for d, t, _ in rows:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode()) + [b"\n"]
        own[d].append(ws)
        if not held(d):
            count.update(ws)
    n, unit = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    for d, texts in own.items():
        assert len(got[d]) == len(texts)
        expected = sorted((len(ws), sum(w in count for w in ws), n, held(d), round(sum(math.log10((count[w] + 0.1) / unit) for w in ws), 6)) for ws in texts)
        assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], round(r["base_score"], 6)) for r in got[d]) == expected
        assert all(r["score"] < 0 for r in got[d])


def test_context_mixing_beats_the_base(spark):
    """On texts that it has not learnt from, of the given tables."""
    out = context_mixing.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    score, base = out.selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def learnt_model(texts):
    """(model, ids, first, cls, hash, tail) of a few texts, learnt and merged as the tasks do."""
    import pyarrow as pa

    ids, first, words = context_mixing.cut_words(pa.array(texts))
    n = len(words)
    cls, h = np.arange(n, dtype=np.uint8) % 128, np.arange(n, dtype=np.uint32) * np.uint32(2654435761)
    states = []
    for half in (slice(0, 3), slice(3, None)):
        m = context_mixing.Learner(context_mixing.SLOTS, 4, context_mixing.RUNS)
        lo = first[half][0]
        hi = first[half.stop] if half.stop else len(ids)
        context_mixing.learn_classes(m, context_mixing.Tokens.of(ids[lo:hi], first[half] - lo, cls, h))
        states += list(m.state())
    rows = sorted((r for b in states for r in b.to_pylist()), key=lambda r: r["piece"])
    merged = [r for b in context_mixing._merged(iter([pa.RecordBatch.from_pylist(rows, schema=states[0].schema)])) for r in b.to_pylist()]
    return merged, ids, first, cls, h, np.full(n, -2.5)


def test_scores_match_a_plain_scorer(spark):
    """The arrays' scores against a scorer that takes one decision after another, by the definition."""
    cm = context_mixing
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab[: rng.randint(3, 40)]) for _ in range(n)) for n in (0, 1, 2, 50, 200, 90)] + ["a b c " * 40]
    merged, ids, first, cls, h, tail = learnt_model(texts)
    df = spark.createDataFrame([(r["piece"], bytearray(r["at"]), bytearray(r["what"])) for r in merged], "piece int, at binary, what binary")
    model = cm.merged_model(df, cm.SLOTS, 4, cm.RUNS)
    got = cm.text_bits(model, ids, first, cls, h, tail)
    starts = cm._starts(cm.SLOTS)
    # the counts are those of all texts
    counts = Counter()
    out = []
    for t, lo in enumerate(first):
        own = ids[lo : first[t + 1] if t + 1 < len(first) else len(ids)]
        last, moved, level = {}, np.zeros(4, np.float32), 0
        run, pull, steps = 0, np.zeros(4), 0
        for i, w in enumerate(own):
            step = 0 if i < cm.FIRST_STEP else int(math.log2(i / cm.FIRST_STEP)) + 1
            if step != level:  # a step of tokens is over: the text's weights move
                moved = moved + np.float32(cm.OWN_RATE) * pull / math.sqrt(1 + steps) / cm.CLASS_BITS
                pull, steps, level = np.zeros(4), 0, step
            c = cls[own]
            one, two = (c[i - 1] if i else 0), (c[i - 2] if i > 1 else 0)
            word = int(h[own[i - 1]]) if i else 0
            pair = (own[i - 2], own[i - 1]) if i > 1 else None
            guess = last.get(pair) if pair else None
            group = 1 + min(run, cm.RUNS - 2) if guess is not None else 0
            node, bits, on = 1, 0.0, guess is not None
            for j in range(cm.CLASS_BITS):
                bit = int(c[i]) >> (cm.CLASS_BITS - 1 - j) & 1
                told = int(cls[guess]) >> (cm.CLASS_BITS - 1 - j) & 1 if on else 0
                slots = [int(one) << 7 | node, (int(two) << 14 | int(one) << 7 | node) + int(starts[1]), ((word & (1 << 14) - 1) << 7 | node) + int(starts[2])]
                st = np.array([*model.stretch[slots], (4.0 * told - 2 if on else 0.0)], np.float32)
                gate = group * cm.CONF + int(model.confidence[slots[2] - int(starts[2])])
                mix = float(np.clip((model.weights[:, gate] + moved.astype(np.float32)) @ st, -12, 12))
                x = (min(max(mix, -8), 8) + 8) * 2
                cell = min(int(x), cm.CELLS - 2)
                p = 0.5 / (1 + math.exp(-mix)) + 0.5 * (model.refined[group][cell] * (1 - x + cell) + model.refined[group][cell + 1] * (x - cell))
                p = min(max(p, 2.0**-18), 1 - 2.0**-18)
                bits += math.log2(p if bit else 1 - p)
                pull += (bit - p) * st
                on = on and told == bit
                for s in slots:
                    counts[s, bit] += 1
                node = node << 1 | bit
            hit = guess is not None and guess == w
            if guess is not None and cls[guess] == c[i]:
                p = model.hit[group]
                bits += math.log2(p) if hit else math.log2(1 - p) + tail[w]
            else:
                bits += tail[w]
            run = run + 1 if hit else 0
            steps += 1
            if pair:
                last[pair] = w
            out.append(bits)
    assert got == pytest.approx(out, rel=1e-3, abs=1e-3)
    summed = Counter()
    for r in merged:
        if r["piece"] >= 0:
            for a, c in zip(cm._opened(r["at"], np.uint16), cm._opened(r["what"], np.float32).reshape(-1, 2), strict=True):
                for b in (0, 1):
                    if c[b]:
                        summed[r["piece"] * cm.PIECE + int(a), b] += int(c[b])
    assert summed == counts


def test_class_and_spelling_probabilities_sum_to_one(spark):
    cm = context_mixing
    merged, *_ = learnt_model(["a b c a b c", "b c", "c a b " * 30, "x y z", "a"])
    df = spark.createDataFrame([(r["piece"], bytearray(r["at"]), bytearray(r["what"])) for r in merged], "piece int, at binary, what binary")
    model = cm.merged_model(df, cm.SLOTS, 4, cm.RUNS)
    # the next token after "a b": all classes, with the same past
    n = cm.CLASSES
    cls = np.arange(n + 2, dtype=np.uint8)
    ids = np.array([[n, n + 1, i] for i in range(n)]).ravel()
    cls = np.append(np.arange(n), [1, 2]).astype(np.uint8)
    bits = cm.class_bits(model, cm.Tokens.of(ids, np.arange(n) * 3, cls, np.arange(n + 2, dtype=np.uint32)), np.arange(n) * 3)
    assert (2.0 ** bits[2::3]).sum() == pytest.approx(1.0, abs=1e-6)
    m = cm.Learner(cm.SPELL_SLOTS, 4, 1)
    slots, bit, _ = cm.spelling([b"abc", b"abd", b"ba"])
    m.learn(slots, None, np.zeros(len(bit), np.int64), bit)
    rows = [r for b in m.state() for r in b.to_pylist()]
    df = spark.createDataFrame([(r["piece"], bytearray(r["at"]), bytearray(r["what"])) for r in rows], "piece int, at binary, what binary")
    model = cm.merged_model(df, cm.SPELL_SLOTS, 4, 1)
    slots, bit, _ = cm.spelling([b"a" + bytes([b]) for b in range(256) if b != 32])
    p, _ = model.predict(slots, None, np.zeros(len(bit), np.int64))
    second = np.log2(np.where(bit == 1, p, 1 - p)).reshape(-1, 24)[:, 8:16].sum(1)
    slots, bit, _ = cm.spelling([b"a"])
    p, _ = model.predict(slots, None, np.zeros(len(bit), np.int64))
    end = np.log2(np.where(bit == 1, p, 1 - p))[1].sum()
    assert (2.0**second).sum() + 2.0**end == pytest.approx(1.0, abs=1e-6)


def test_pipeline(spark, tmp_path, corpus):
    """The whole run against a plain one, rows with repeated and null ids among them."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    fine = lambda i, n: " ".join(f"v{i * 31 % 97}{j * j % 89}" for j in range(n))
    texts = [*corpus, *((20_000 + i, fine(i, 40 + i % 7), f"s{i % 3}") for i in range(80)), (None, fine(500, 60), "s1"), (None, fine(501, 60), "s2"), (None, fine(501, 60), "s2"), (20_001, fine(600, 50), None), (20_001, fine(600, 50), None)]
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    # quality rules, a row at a time
    good = []
    for r in rows:
        m = {k: int(v[0]) for k, v in quality.measure([r[1]]).items()}
        fails = (m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"], 10 * m["n_symbols"] > 3 * m["n_words"], m["n_lines"] >= 4 and 100 * m["n_dup_lines"] > 50 * m["n_lines"])
        fails += (m["word_chars"] > 15 * m["n_words"], m["word_chars"] < 2 * m["n_words"], 100 * m["n_bangs"] > 50 * m["n_words"])
        if not any(fails):
            good.append(r)
    late = lambda r: (r[0] is None, r[0] or 0)
    # exact copies: the smallest id of each text
    first = {}
    for r in sorted(good, key=late):
        first.setdefault(SPACE.sub(" ", r[1]), r)
    exact = list(first.values())
    # near copies: the smallest row of each component
    sets = []
    for r in exact:
        w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    order = sorted(range(len(exact)), key=lambda i: late(exact[i]))
    place = {i: k for k, i in enumerate(order)}
    forest = Forest()
    for a, b in itertools.combinations(range(len(exact)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            forest.join(place[a], place[b])
    near = [exact[i] for i in range(len(exact)) if forest.find(place[i]) == place[i]]
    # the mix: each row as often as the shares say
    mixed = Counter()
    size, total = Counter(), sum(len(words(r[1])) for r in near)
    for r in near:
        size[r[3]] += len(words(r[1]))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        level = (1.5 * total - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        goal = 2 * size[s] if s in capped else level * weight[s]
        whole = int(goal / size[s]) if size[s] else 0
        rank = lambda r: (hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest(), late(r), len(words(r[1])))
        upto, rest = 0, goal - whole * size[s]
        buckets = defaultdict(list)
        for r in sorted((r for r in near if r[3] == s), key=rank):
            buckets[rank(r)[0][:3]].append(r)
        for own in buckets.values():
            n = sum(len(words(r[1])) for r in own)
            at = upto
            for r in own:
                k = len(words(r[1]))
                at += k
                extra = 1 if upto + n <= rest else 0 if upto >= rest else int(at - k / 2 <= rest)
                mixed[r] = min(whole + extra, 2)
            upto += n
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for r, n in mixed.items():
        ids = tok.encode(r[1], add_special_tokens=False).ids
        expected[r[0], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +expected
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).columns == docs.columns
