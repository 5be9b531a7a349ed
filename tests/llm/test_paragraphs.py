"""Lines, blocks and windows of the substring dedup against brute force; its scratch files."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from forgecast.llm import paragraphs
from forgecast.llm import textkit as K
from forgecast.llm.graph import Scratch, Similarity
from forgecast.llm.paragraphs import cut_paragraphs, repeated_paragraphs


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").lower())


def _similar_units(rows, min_words):
    """Brute force: units of every text and the pairs of them that reach 0.8."""
    units = []
    for i, text in rows:
        if text:
            (_, t), = K.slices(pa.array([text], pa.large_string()), max(1, len(text.encode())))
            w = words(text)
            u = paragraphs.paragraphs_of(t, min_words)
            for a, n, b in zip(u.first.tolist(), u.words.tolist(), u.block.tolist(), strict=True):
                part = w[a:a + n]
                units.append((i, a, n, {tuple(part[k:k + 5]) for k in range(n - 4)}, b))
    pairs = [(u, v) for k, u in enumerate(units) for v in units[k + 1:]
             if u[4] == v[4] and 5 * len(u[3] & v[3]) >= 4 * len(u[3] | v[3])]
    return units, pairs


def test_similar_paragraphs_equal_brute_force(spark):
    """Edited, wrapped and short paragraphs: links of lines and blocks, and what is left."""
    rng = random.Random(29)

    def prose(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def wrapped(w, n):
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    def edited(w, every):
        return [f"e{rng.randrange(10**6)}" if k % every == every // 2 else x
                for k, x in enumerate(w)]

    rows, long_ones = [], []
    for k in range(12):
        p = prose(400)
        long_ones.append((len(rows), 200 + len(rows)))
        rows.append((len(rows), " ".join(prose(30) + p + prose(30))))
        rows.append((200 + len(rows) - 1, wrapped(prose(17) + edited(p, 80) + prose(9), 12)))
    short = prose(38)
    rows += [(100, " ".join(prose(60)) + "\n" + " ".join(short)),
             (101, " ".join(short) + "\n" + " ".join(prose(70))),
             (102, " ".join(short[:-1] + ["other"])), (103, "\n".join([" ".join(prose(30))] * 2)),
             (104, None), (105, ""), (106, " ".join(["same"] * 5000)), (107, " ".join(prose(19)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    found = paragraphs.similar_paragraphs(frame, paragraphs.MIN_WORDS, Similarity(), scratch)
    got = {(r.doc_id, r.first_word, r.n_words) for r in found.collect()}
    units, pairs = _similar_units(rows, paragraphs.MIN_WORDS)
    later = {max((u, v), key=lambda x: x[:2])[:3] for u, v in pairs}
    assert len(later) > 30 and len(got & later) >= 0.9 * len(later)
    assert got <= {x[:3] for pair in pairs for x in pair}
    assert {(101, 0, 38), (102, 0, 38), (103, 30, 30)} <= got
    # nothing of a first occurrence goes
    assert not {x for x in got if x[0] in (0, 100, 104, 105, 106, 107)}
    left = {r.doc_id: r.text for r in cut_paragraphs(
        frame, repeated_paragraphs(frame)).collect()}
    for first, again in long_ones:
        whole = dict(rows)
        assert left[first] == whole[first]
        assert len(words(left[again])) < 0.5 * len(words(whole[again]))
    assert words(left[101]) == words(dict(rows)[101])[38:] and 102 not in left


def test_blocks_do_not_depend_on_what_surrounds_them():
    rng = np.random.default_rng(5)
    p = rng.integers(0, 2**63, 600, dtype=np.uint64)
    ends = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 3, 130)]
    starts = []
    for a in ends:
        for b in ends:
            h = np.concatenate([a, p, b])
            row = np.zeros(len(h), np.int64)
            at = np.flatnonzero(paragraphs.block_starts(h, row)) - len(a)
            starts.append([x for x in at.tolist() if 49 <= x < 550])
    assert len(starts[0]) > 2 and all(s == starts[0] for s in starts)
    two = paragraphs.block_starts(np.concatenate([p, p]), np.repeat([0, 1], 600))
    assert (two[:600] == two[600:]).all()
    assert not len(paragraphs.block_starts(p[:0], np.zeros(0, np.int64)))
    assert paragraphs.block_starts(p[:1], np.zeros(1, np.int64)).tolist() == [True]


def _brute_windows(rows):
    """Brute force: each kept window that isn't its first occurrence, grown word by word."""
    n, more = paragraphs.WINDOW_WORDS, paragraphs.WINNOW
    texts, lines, places = {}, {}, {}
    for i, text in rows:
        found = [(m.group().lower(), m.start()) for m in re.finditer("[^\x20\x09-\x0d]+", text or "")]
        texts[i] = [w for w, _ in found]
        lines[i] = [text[:a].count("\n") for _, a in found]
        if found:
            (_, t), = K.slices(pa.array([text], pa.large_string()), max(1, len(text.encode())))
            w = K.split_words(t, K.SPACES)
            h = K.segment_hash(t.buf, w.starts, w.ends, K.FOLDED)
            for a in paragraphs.winnowed(h, w.rows())[0].tolist():
                places.setdefault(tuple(texts[i][a:a + n]), []).append((i, a))
    out = set()
    for where in places.values():
        k, b = min(where)
        for i, a in where:
            if (i, a) == (k, b):
                continue
            x, y, lo, hi = texts[i], texts[k], 0, 0
            while lo < more and min(a, b) > lo and x[a - lo - 1] == y[b - lo - 1]:
                lo += 1
            while (hi < more and a + n + hi < len(x) and b + n + hi < len(y)
                   and x[a + n + hi] == y[b + n + hi]):
                hi += 1
            first = max(a - lo, b + n) if i == k else a - lo
            if first < a + n + hi:
                out.add((i, lines[i][a], first, a + n + hi - first, k, lines[k][b], first - (a - b)))
    return out


def test_repeated_windows_equal_brute_force(spark):
    """Chains of windows give the ranges that each window gives by itself: passages with
    edits, of several sources, at both ends of a text, inside one text, and periodic ones."""
    rng = random.Random(31)

    def prose(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def text(w):
        return "".join(x + rng.choice("   \n") for x in w)

    p, q, short = prose(400), prose(130), prose(50)
    edited = [f"e{k}" if k % 90 == 45 else x for k, x in enumerate(p)]
    rows = [(1, text(p)), (2, text(prose(20) + p + prose(3))), (3, text(p[150:] + q)),
            (4, text(prose(7) + edited + q + short)), (5, text(short + prose(40) + p[:60])),
            (6, text(q + prose(30) + q + q)), (7, text(["same"] * 300)),
            (8, text(["same", "again"] * 90)), (9, text(["same"] * 70 + short)),
            (10, None), (11, ""), (12, text(prose(80)))]
    frame = spark.createDataFrame(rows + rows[:4], "doc_id long, text string")
    got = {tuple(r) for r in paragraphs.repeated_windows(frame, Scratch(spark, "test")).collect()}
    assert len({x[0] for x in got}) == 8 and got == _brute_windows(rows)


def test_texts_with_one_id_make_no_chain(spark):
    """Windows of two texts with one id lie side by side by number, not in one text."""
    rng = random.Random(37)
    p = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    own = [[f"o{k}_{i}" for i in range(150)] for k in range(2)]
    rows = [(1, " ".join(p)), (2, " ".join(p[:150] + own[0])), (2, " ".join(own[1] + p[150:]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_windows(frame, Scratch(spark, "test")).collect()
    gone = {w for r in found for w in range(r.first_word, r.first_word + r.n_words)}
    assert gone == set(range(300)) and all(r.kept_first_word == r.first_word for r in found)
    assert not [r for r in found if r.first_word < 150 < r.first_word + r.n_words]


def test_words_around_windows_are_kept_at_the_ends_of_chains_only(spark, monkeypatch):
    rng = random.Random(41)
    p = " ".join(f"v{rng.randrange(10**6)}" for _ in range(3000))
    frame = spark.createDataFrame([(i, f"w{i} {p} x{i}") for i in range(6)],
                                  "doc_id long, text string")
    sizes, store = {}, Scratch.store

    def counted(self, df, name, *args, **kwargs):
        out = store(self, df, name, *args, **kwargs)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "store", counted)
    paragraphs.repeated_windows(frame, Scratch(spark, "test"))
    assert sizes["common"] > 1000 and sizes["chains"] == 5 and sizes["around"] == 12


def test_dropped_tables_take_their_shuffle_files_with_them(spark):
    def shuffled():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    scratch = Scratch(spark, "test")
    scratch.drop()
    time.sleep(2)
    before = shuffled()
    scratch.store(spark.range(10000).groupBy((F.col("id") % 5000).alias("k")).count(), "sums")
    made = shuffled() - before
    assert made
    scratch.store(spark.range(10), "next")  # Spark itself holds on to the last job
    scratch.drop("sums")
    for _ in range(50):
        if not made & shuffled():
            break
        time.sleep(0.2)
    assert not made & shuffled()


def _plans(monkeypatch):
    """Plans of the tables that are stored from here on, by name."""
    plans, store = {}, Scratch.store

    def noted(self, df, name, *args, **kwargs):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(self, df, name, *args, **kwargs)

    monkeypatch.setattr(Scratch, "store", noted)
    return plans


def _copies(spark):
    rng = random.Random(43)
    p = "\n".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(i, f"w{i} {p} x{i}") for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_around_windows_are_not_sorted_or_joined_with_their_chains(spark, monkeypatch):
    """A text's own chains lie beside it, so its words around them need no join of their own."""
    frame, plans = _copies(spark), _plans(monkeypatch)
    paragraphs.repeated_windows(frame, Scratch(spark, "test"))
    assert "Aggregate" not in plans["around"].split("MapInArrow")[0]
    assert plans["more"].count("SortMergeJoin") == 1
    assert "SortMergeJoin" not in plans["common"]


def test_bands_are_gone_before_links_and_texts_are_joined_alike_at_every_size(spark, monkeypatch):
    frame, plans, there, link = _copies(spark), _plans(monkeypatch), [], paragraphs.link

    def noted(postings, sketches, sets_of, sim, scratch, *args, **kwargs):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.base)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        there.extend(x.getPath().getName() for x in path.getFileSystem(conf).listStatus(path))
        return link(postings, sketches, sets_of, sim, scratch, *args, **kwargs)

    monkeypatch.setattr(paragraphs, "link", noted)
    left = cut_paragraphs(frame, repeated_paragraphs(frame))
    assert sorted(there) == ["postings", "sketches", "units"]
    for plan in (plans["around"], left._jdf.queryExecution().executedPlan().toString()):
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert [r.doc_id for r in left.collect() if "v" in r.text] == [0]
