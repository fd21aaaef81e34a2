"""Merkle witnesses, periodic runs and token transducers against brute force, on awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eospark.llm import manifest, packing, periodic_runs, queries, token_counts, toxicity

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, _key string, _idx string, id string"


def rows():
    rng = random.Random(5)
    out = [(i, f"s{i % 3}", rng.choice(["en", "de", "zh-é"]), i * 7, f"text {i} é日") for i in range(150)]
    out += [(150, None, None, None, None), (151, "s", None, 3, ""), (152, "s", "fr", None, "lone"), (None, "s", "en", 5, "no id"), (7, "s", "en", 1, "same id")]
    out += [out[3], out[3], (154, "s", "", 4, "empty lang"), (14, "s", None, 9, "x" * 50000)]
    return [(*r, "clash", "clash", "clash") for r in out]


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_leaf(r, add=0):
    vals = [r[0], r[1], r[2], None if r[3] is None else r[3] + add, r[4]]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])


def tree(leaves):
    """Root, and for each leaf its siblings with their side, by building every level."""
    paths, level = [[] for _ in leaves], list(leaves)
    where = list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(where):
            if at ^ 1 < len(level):
                paths[i].append((level[at ^ 1], at & 1))
            else:
                paths[i].append(None)
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
        where = [at // 2 for at in where]
    return level[0], paths


def brute_manifest(table):
    by = {}
    for r in table:
        by.setdefault(r[2], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    low = {}
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, row_leaf(r)))
        low[k] = tree([row_leaf(r) for r in by[k]])
    root, tops = tree([low[k][0] for k in keys])
    out = []
    for k, top in zip(keys, tops, strict=True):
        for r, path in zip(by[k], low[k][1], strict=True):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = row_leaf(r, int(tampered))
            for step in path:
                fold = H(fold) if step is None else H(step[0], fold) if step[1] else H(fold, step[0])
            out.append((r[0], row_leaf(r), low[k][0], root, H(*[s[0] for s in path if s]), fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_merkle_witnesses(spark, bits):
    """Small blocks make many rounds of appended block roots."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = manifest.verify(docs, tampered, {"n_chars": F.col("n_chars") + 1}, bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows())
    assert not all(r["verified"] for r in got)


def test_merkle_small_tables(spark):
    for table in ([], rows()[:1], rows()[150:151]):
        docs = spark.createDataFrame(table, SCHEMA)
        got = manifest.verify(docs, F.lit(False), {}).collect()
        assert [(r["leaf"], r["root"], r["verified"]) for r in got] == [(row_leaf(r), row_leaf(r), True) for r in table]


def test_open_tree_is_online():
    """Witnesses grow as siblings are completed, and hold at every size."""
    for n in range(1, 40):
        leaves = [H(str(i)) for i in range(n)]
        t = manifest.OpenTree(n, 6)
        for d in leaves:
            t.append(d)
        root, paths = tree(leaves)
        assert t.close() == root
        assert [t.witness(i).hex() for i in range(n)] == ["".join(s[0] for s in p if s) for p in paths]


def brute_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - a + p >= max(least, 2 * p):
                out.setdefault((a, i + p - a), p)
            i += 1
    return sorted((a, k, p) for (a, k), p in out.items())


def word_lists():
    rng = random.Random(3)
    out = []
    for _ in range(300):
        k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 90)
        w = [rng.randint(0, k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        out.append(w)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return [*out, fib[-1], [0] * 300, [0, 1] * 150, list(range(40)) * 3]


@pytest.mark.parametrize("least", [2, 12, 40])
@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_runs(monkeypatch, least, chunk):
    """Appended seven words at a time, or all at once."""
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    lists = word_lists()
    got = periodic_runs.find_runs([np.array(w, np.int64) for w in lists], least)
    assert got == [brute_runs(w, least) for w in lists]


def test_runs_survive_misleading_hashes(monkeypatch):
    """With hashes of a few values only, runs are found wrongly at first; they are checked and done again."""
    real, tried = periodic_runs.Catchers._hash, []

    def bad(self, at, to, k):
        if self.seed_is_bad:
            return real(self, at, to, k) % 2
        return real(self, at, to, k)

    init = periodic_runs.Catchers.__init__

    def start(self, least, seed):
        tried.append(seed)
        self.seed_is_bad = seed < 3
        init(self, least, seed)

    monkeypatch.setattr(periodic_runs.Catchers, "_hash", bad)
    monkeypatch.setattr(periodic_runs.Catchers, "__init__", start)
    w = word_lists()[:40]
    assert periodic_runs.find_runs([np.array(x, np.int64) for x in w]) == [brute_runs(x) for x in w]
    assert tried == [1, 2, 3]


def brute_digest(doc_id, text, tails=True):
    words = (text or "").encode().split()
    n = len(words)
    if tails and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, k, p in runs for i in range(a + p, a + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    lines = "".join(f"{a},{k},{p}\n" for a, k, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def awkward_texts():
    rng = random.Random(8)
    words = ["eau", "é", "x1", "le", " ", "日本"]
    out = ["", None, " \t\n", "one", "a " * 30, " a\x0bb\x0cc\rd " * 9, "\x1c \x85   " * 20, "ab " * 4000 + "cd " * 4000]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(out)] + [(None, "b " * 12), (8, out[8]), (8, out[8])]


def test_run_digests(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in awkward_texts()], "doc_id bigint, text string, runs string, id string")
    edited = periodic_runs.with_periodic_tails(docs)
    got = periodic_runs.digest(periodic_runs.periodic_runs(edited)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_digest(i, t) for i, t in awkward_texts()), key=repr)
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


def test_run_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in docs if len((t or "").split()) < 1500}
    got = [tuple(r) for r in queries.QUERIES["op12_dyadic_runs"](spark, sf).collect()]
    assert len(got) == len(docs)
    assert sorted(r for r in got if r[0] in short) == sorted(brute_digest(i, t) for i, t in docs if i in short)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path("word_bpe_49k.json"))


def hard_texts():
    rng = random.Random(1)
    letters = "aaabthe'srevldm'' \n!?.1²é́ΣσİßŁ中文  \x1c\U0001f600͸\U000105c2"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    pick = lambda: chr(rng.choice([rng.randint(1, 0x7F), rng.randint(1, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
    out += ["".join(pick() for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out += ["'re 'r 'll'l 'l 've'v're''s !'s a's 's's 'R'E", "<|endoftext|>É<|startoftext|>́x<|endoftext|", "a" * 2000, "é" * 3000, "haha" * 500, "", " ", "É" + " " * 900]
    return out


@pytest.mark.parametrize("max_states", [40, token_counts.MAX_STATES])
def test_tokens_are_those_of_the_library(library, max_states):
    """With few states the compiled ones are dropped again and again."""
    counter = token_counts.TokenCounter(packing.vocabulary_path("word_bpe_49k.json"), max_states)
    texts = hard_texts() if max_states > 40 else hard_texts()[::7]
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_compose():
    """Words begin at the same places whatever the size of chunks, and as a step-by-step run says."""
    rng = np.random.default_rng(0)
    classes = rng.choice(np.arange(token_counts.ASK), 3000, p=[0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.2, 0.1]).astype(np.uint8)
    state, want = token_counts.FREE, np.zeros(len(classes) + 1, bool)
    for i, c in enumerate([*classes.tolist(), token_counts.GAP]):
        emit, state = token_counts.EMIT[state, c], token_counts.STEP[state, c]
        want[i] |= bool(emit & token_counts.HERE)
        if emit & token_counts.BEFORE:
            want[i - 1] = True
    for chunk in (1, 2, 3, 64, 256, 5000):
        assert np.array_equal(token_counts.word_starts(classes, chunk), want[:-1])


def test_token_counts(spark, library):
    table = [*enumerate([*hard_texts()[-40:], None, "long " * 5000 + "x" * 3000]), (None, "no id"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in table], "doc_id bigint, text string, id int, n_tokens int")
    path = packing.vocabulary_path("word_bpe_49k.json")
    want = sorted([(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in table], key=repr)
    for block in (1 << 20, 50):
        assert sorted(map(tuple, token_counts.token_counts(docs, path, block=block).collect()), key=repr) == want
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.TokenCounter(packing.vocabulary_path("byte_bpe_50k.json"))


def test_token_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    assert sorted(map(tuple, queries.QUERIES["op13_token_transducers"](spark, sf).collect())) == sorted(want)


def test_nothing_is_dropped_without_a_model(spark):
    """Labels without usable words, or none: every row stays, clashing columns too."""
    docs = spark.createDataFrame([(1, "", "k"), (2, None, "k"), (2, None, "k"), (None, "x " * 20000, "k")], "doc_id bigint, text string, score string")
    for known in ([(1, 1), (2, 0)], [], [(9, 1)]):
        labels = spark.createDataFrame(known, "doc_id bigint, toxic int")
        assert toxicity.drop_toxic(docs, labels).count() == 4
        assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
