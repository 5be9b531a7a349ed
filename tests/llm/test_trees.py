"""Suffix dedup, conversation trie and Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from forgecast.llm import merkle, prefix_trie, suffix_runs
from forgecast.llm.merkle import merkle_audit
from forgecast.llm.prefix_trie import conversation_trie
from forgecast.llm.suffix_runs import merged, suffix_dedup

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("tree", T.LongType()), T.StructField("level", T.StringType())])


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ------------------------------------------------------------------ suffixes
def _passages():
    rng = random.Random(5)

    def prose(n):
        return "".join(rng.choice("abcdefghij \né") for _ in range(n))

    shared, long = prose(700), prose(3000)
    edited = list(long)
    for at in (10, 405, 1300, 2000, 2450):
        edited[at] = "#"
    out = [None, "", "short", prose(399), "é" * 200, "é" * 200 + "x", long, long, "".join(edited),
           "x" * 2500, "ab" * 900, prose(300) + shared + prose(50), shared + prose(20),
           prose(40) + shared[:420], prose(40) + shared[:395], shared[150:560] + prose(9),
           prose(5) + shared[100:505] + "!" + shared[300:] + prose(500), prose(20000)]
    # one passage in many texts, each with its own surroundings
    out += [prose(rng.randrange(300)) + shared + prose(rng.randrange(300)) for _ in range(40)]
    return out


def _kept(texts, n=suffix_runs.WINDOW):
    raw = [(t or "").encode() for t in texts]
    places = defaultdict(int)
    for b in raw:
        for p in range(len(b) - n + 1):
            places[b[p:p + n]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - n + 1):
            if places[b[p:p + n]] > 1:
                gone[p + 1:p + n + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        left = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), int(gone.sum()), spans, sha(left)))
    return out


@pytest.mark.parametrize("hot", [suffix_runs.HOT_ENTRIES, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_runs, "HOT_ENTRIES", hot)
    texts = _passages()
    rows = [(i % 50, t, None, "s", None, "k", 1, "l") for i, t in enumerate(texts)]
    rows[3] = (None, *rows[3][1:])
    got = suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    expected = [(r[0], *k) for r, k in zip(rows, _kept(texts), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_loser_tree_never_needs_known_prefixes():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(400)]
    for runs in (1, 2, 3, 7, 16):
        made = []
        for k in range(runs):
            run = suffix_runs._Run()
            for w in words[k::runs]:
                run.add(0, w, b"", bytes(16), len(made), 1)
            b, = run.packs()
            made.append(suffix_runs._Reader(k, b.column(1)[0].as_py(), b.column(2)[0].as_py()))
        out, lcp = [], []
        for r in merged(made):
            out.append(r.suffix)
            lcp.append(r.lcp)
        assert out == sorted(w for k in range(runs) for w in set(words[k::runs]))
        for a, b, h in zip(out, out[1:], lcp[1:], strict=False):
            assert h == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y),
                             min(len(a), len(b)))


def test_anchors_depend_on_the_window_only():
    rng = random.Random(9)
    inner = "".join(rng.choice("abcd") for _ in range(800))
    seen = set()
    for _ in range(5):
        before = "".join(rng.choice("abcd") for _ in range(rng.randrange(500)))
        text = before + inner + "".join(rng.choice("abcd") for _ in range(300))
        (_, t), = suffix_runs.K.slices(pa.array([text]))
        found = {}
        for _, at, near, far, _ in zip(*suffix_runs._anchors(t), strict=True):
            for o in range(near, far + 1):
                found[int(at - o)] = int(at)
        assert sorted(found) == list(range(len(text) - suffix_runs.WINDOW + 1))
        seen.add(tuple(found[len(before) + p] - len(before) for p in range(401)))
    assert len(seen) == 1


# --------------------------------------------------------------- conversations
TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])


def _conversations():
    rng = random.Random(2)
    rows = []
    for c in [*range(300), 1007, 1105, 1200, 1203, -100, -7, 10**12]:
        for t in range(rng.choice((1, 1, 2, 4, 7))):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", None)),
                         rng.choice(("a", "bb", "é\n", None)) if rng.random() < 0.8 else str(c),
                         "clash", 1))
    rows += [r for r in rows if r[0] == 12]  # repeated rows
    return [*rows, (None, 0, "user", "x", "k", 1)]


def _trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, d, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p],
                   saved[p], sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))))
                  for p, m in members.items())


@pytest.mark.parametrize(("parts", "items"), [(1, 50_000), (7, 50_000), (40, 20)])
def test_trie_equals_brute_force(spark, monkeypatch, parts, items):
    monkeypatch.setattr(prefix_trie, "OPEN_ITEMS", items)
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 2)
    rows = _conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = conversation_trie(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
        assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == _trie(rows)


# -------------------------------------------------------------------- manifest
def _framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def _siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 3 * 3
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1:lo + 3])))
        i //= 3
    return out


def _audit(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join(map(_framed, (doc_id, source, lang, n_chars, text))))

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = _siblings(trees[s], i) + _siblings(top, k)
            cut = r[1]
            if r[0] is not None and cut is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                cut = cut.replace("\n", "")
            at = leaf(r[0], cut, *r[2:5])
            for left, right in path:
                at = sha(left + at + right)
            root = top[-1][0]
            out.append((r[0], own, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), at,
                        at == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (2, 2), (40, 1), (200, 5), (60, 60)])
def test_merkle_equals_brute_force(spark, n, sources):
    rng = random.Random(n)
    names = [None, "", "é", "a", "Z", *(f"s{i}" for i in range(60))][:sources]
    rows = [(i if rng.random() < 0.9 else None, rng.choice((None, "", f"t{i}", f"a\nb{i}\n" * 3)),
             rng.choice(("en", None)), rng.choice(names), rng.choice((None, 5)), "k", 7, "l")
            for i in range(n)]
    rows += rows[:1] * (3 if n == 200 else 0)  # repeated rows, and an id of several rows
    rows += [(rows[0][0], "other", None, names[0], None, "k", 7, "l")] if n == 200 else []
    got = merkle_audit(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == _audit(rows)


def test_merkle_of_nothing(spark):
    out = merkle_audit(spark.createDataFrame([], DOCS))
    assert out.count() == 0
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]


def test_merkle_broadcast_and_shuffle_agree(spark, monkeypatch):
    rows = [(i, f"t{i}", "en", f"s{i % 7}", 1, "k", 7, "l") for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(map(tuple, merkle_audit(docs).collect()))
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, merkle_audit(docs).collect())) == one
