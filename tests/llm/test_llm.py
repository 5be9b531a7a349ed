"""Small brute-force tests of the training-data operators."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from forgecast.llm import decontaminate, ngram_join, paragraphs, pieces
from forgecast.llm.decontaminate import contaminated
from forgecast.llm.graph import Scratch, Similarity, components
from forgecast.llm import licenses as L
from forgecast.llm.licenses import license_scan
from forgecast.llm.ngram_join import ngram_jaccard_join
from forgecast.llm.paragraphs import cut_paragraphs, repeated_paragraphs
from forgecast.llm.piece_codec import codec_digest, decode, encode
from forgecast.llm.quality import quality_rules
from forgecast.llm.sharding import first_map, rebalance, shard_rows, slotted
from forgecast.llm.token_counts import token_counts
from forgecast.llm.toxicity import toxicity_scores
from forgecast.llm.url_lists import listed, page_captures, page_list_events

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()),
    T.StructField("key", T.LongType())])
_SPACE = "\x20\x09-\x0d"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(f"[^{_SPACE}]+", lower)


def shingles(text):
    w = words(text)
    return ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5
            else {tuple(w)} if w else set())


def _texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(120), prose(60)
    out = [None, "", " \n\t", "one", "One  two\nthree", base, base, base.upper()]
    for edits in (1, 2, 3, 5, 9):  # near copies around one centre
        for _ in range(6):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
            out.append(" ".join(w))
    out += [prose(30) + "\n" + passage + "\n" + prose(20) for _ in range(4)]
    out += [passage + "\n" + passage, "a b c d e f g h i j " * 40, prose(20000), "x" * 30000,
            "▁ café \U0001F600 z  y"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, "clash", 1) for i, t in enumerate(_texts())]
    rows.append((5, rows[5][1], None, None, None, None, None))  # repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(docs, empty):
    assert quality_rules(empty).count() == 0
    for r in quality_rules(docs.dropDuplicates(["doc_id"])).collect():
        text = _texts()[r.doc_id] or ""
        w = re.findall(f"[^{_SPACE}]+", text)
        seen, twice = set(), 0
        for line in text.split("\n"):
            if re.search(f"[^{_SPACE}]", line):
                twice += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i:i + 5])] > 1:
                covered |= set(range(i, i + 5))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), twice, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_ngram_join_equals_brute_force(docs, empty):
    assert ngram_jaccard_join(empty).count() == 0
    sets = {i: shingles(t) for i, t in enumerate(_texts())}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = ngram_jaccard_join(docs).collect()
    assert len(got) == len(_texts()) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert len({find(x) for x in sets}) < len(sets)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(11)
    names = rng.sample(range(-10**9, 10**9), 400)
    edges = [(names[i], names[i + 1]) for i in range(120)]  # a chain in random order
    edges += [(names[150], names[150 + i]) for i in range(1, 80)]  # a star
    edges += [(names[240 + i], names[240 + (i + 1) % 50]) for i in range(50)]  # a cycle
    edges += [(names[300], names[300]), *edges[:30]]  # itself, and repeated edges
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = components(frame, Scratch(spark, "test"), "rounds").collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in names if find(x) != x)
    assert components(frame.limit(0), Scratch(spark, "test"), "none").count() == 0


def test_repeated_paragraphs(docs, empty):
    assert repeated_paragraphs(empty).count() == 0
    removed = repeated_paragraphs(docs)
    got = {(r.doc_id, r.line, r.kept_doc_id, r.kept_line) for r in removed.collect()}
    texts = _texts()
    at = next(i for i, t in enumerate(texts) if t and t.count("\n") == 2 and len(words(t)) == 110)
    passages = [(at + k, 1, at, 1) for k in range(1, 4)] + [(at + 4, k, at, 1) for k in (0, 1)]
    assert set(passages) <= got
    assert (6, 0, 5, 0) in got and (7, 0, 5, 0) in got
    left = {r.doc_id: r.text for r in cut_paragraphs(docs, removed).collect()}
    assert left[at] == texts[at] and left[at + 1] == "\n".join(texts[at + 1].split("\n")[::2])
    assert at + 4 not in left and left[3] == "one"
    bands, rows = paragraphs.tune_bands(0.8)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.99


def test_decontamination(spark, docs, empty):
    rng = random.Random(3)
    item = [f"q{rng.randrange(10**6)}" for _ in range(30)]
    near = list(item)
    for i in (4, 11, 20):
        near[i] = "edit"
    far = [x if i % 2 else "z" for i, x in enumerate(item)]
    rows = [(100, "so it is " + " ".join(item).upper() + " end"), (101, "a b\n" + " ".join(near)),
            (102, " ".join(far)), (103, None), (104, " ".join(item[:12]))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")],
                                  "item_id long, text string")
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {tuple(r) for r in found} == {(100, 1, 3, 0), (101, 1, 2, 3)}
    assert contaminated(empty, items).count() == 0
    assert contaminated(docs, items.where("item_id = 9")).count() == 0


def test_edit_distance_and_recall():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 4, (50, 9)).astype(np.uint64), rng.integers(0, 4, (50, 9)).astype(
        np.uint64)

    def plain(x, y):
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        d[:, 0], d[0] = range(len(x) + 1), range(len(y) + 1)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1,
                              d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
        return d[-1, -1]

    assert decontaminate.edit_distances(a, b).tolist() == [plain(x, y)
                                                           for x, y in zip(a, b, strict=True)]
    # windows with the largest number of substitutions meet their item
    x = rng.integers(1, 2**63, (300, 40), dtype=np.uint64)
    y = x.copy()
    for row in y:
        row[rng.choice(40, 8, replace=False)] = rng.integers(1, 2**62, 8)
    met, who, length = np.zeros(300, bool), np.arange(300), np.full(300, 40)
    for r in range(decontaminate.repetitions()):
        s = np.repeat(decontaminate.sampled_steps(np.array([40]), r), 300, axis=0)
        met |= (decontaminate.walk_keys(x, who, length, s, r)
                == decontaminate.walk_keys(y, who, length, s, r))
    assert met.mean() >= 0.97


def test_codec_round_trip_and_counts(docs, empty):
    assert decode(encode(empty)).count() == 0 and token_counts(empty).count() == 0
    rows = docs.dropDuplicates(["doc_id"])
    done = {r.doc_id: r for r in decode(encode(rows)).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts(rows).collect()}
    for i, text in enumerate(_texts()):
        assert done[i].decoded == text
        assert len(done[i].ids or []) == counts[i]
    digest = {r.doc_id: r for r in codec_digest(rows).collect()}
    assert all(r.round_trip for r in digest.values()) and len(digest) == len(done)
    assert all(digest[i].n_tokens == len(r.ids)
               for i, r in done.items() if r.ids is not None)


def test_best_paths_equal_one_by_one():
    v = pieces.load_vocabulary()
    rng = random.Random(1)
    chunks = [" " + "".join(rng.choice("theaingé$日") for _ in range(6)) for _ in range(300)]
    for n in {len(c.encode()) for c in chunks}:
        same = [c.encode() for c in chunks if len(c.encode()) == n]
        ids, counts, scores = pieces.best_paths(
            v, np.frombuffer(b"".join(same), np.uint8).reshape(-1, n))
        for c, part, s in zip(same, np.split(ids, np.cumsum(counts)[:-1]), scores, strict=True):
            one, score = pieces.best_path(v, c)
            assert part.tolist() == one and abs(score - s) < 1e-9


def test_sharding(docs, empty, spark):
    assert shard_rows(empty).count() == 0
    got = shard_rows(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        text = (_texts()[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "bytes")
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(by) < 40
    # rebalancing evens out the bytes and leaves a balanced map as it is
    load = spark.createDataFrame([(i, 100 if i % 4 else 700) for i in range(64)],
                                 "slot int, bytes long")
    v1 = first_map(spark, 64, 4)
    v2 = rebalance(v1, load, 4)
    size = {r[0]: r[1] for r in v2.join(load, "slot").groupBy("shard").sum("bytes").collect()}
    assert set(size.values()) == {4000}
    v3 = rebalance(v2, load, 4)
    assert v3.where("version = 3").join(v2.select("slot", "shard"), ["slot", "shard"]).count() == 64


def test_sharding_of_equal_rows(spark):
    rows = [(None, "a" * 500)] * 4000 + [(i, "b" * (i % 900)) for i in range(4000)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 8000 and sum(r.doc_id is None for r in got) == 4000
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(size) == 40 and max(size.values()) - min(size.values()) < 1000
    assert len({r.virtual_slot for r in got if r.doc_id is None}) > 2000


def test_copies_in_parts(spark):
    groups = spark.createDataFrame([(1, 20, 7, 25), (2, 30, 8, 3), (None, 16, 0, 10)],
                                   "doc_id long, size long, text_crc32 long, n long")
    whole, parts = (sorted(map(str, slotted(groups, 64, n).collect())) for n in (100, 10))
    assert whole == parts and len(whole) == 38


def test_kept_map(spark, tmp_path):
    path = f"{tmp_path}/map"
    docs = spark.createDataFrame([(i, "b" * (i % 900)) for i in range(3000)],
                                 "doc_id long, text string")
    first = {r.virtual_slot: r.shard for r in shard_rows(docs, map_path=path).collect()}
    grown = docs.union(spark.createDataFrame([(9999, "c" * 5000)], docs.schema))
    second = {r.virtual_slot: r.shard for r in shard_rows(grown, map_path=path).collect()}
    # the later run starts from the kept version, and growth in one slot moves few slots
    assert sum(second[k] != v for k, v in first.items()) < len(first) // 10
    kept = spark.read.parquet(path)
    assert {r[0]: r[1] for r in kept.groupBy("version").count().collect()} == dict.fromkeys(
        (1, 2, 3), 4096)


def test_license_scan(spark, empty):
    assert license_scan(empty).count() == 0
    rows = [(1, "Text.\nReleased UNDER the MIT License."), (2, None), (3, "mit license"),
            (4, "Licensed under the Apache License, Version 2.0\nLicensed under CC BY-NC 4.0"),
            (5, "This work is licensed under the GNU General Public License, version 3"),
            (6, "released under the\nlicense mit")]
    got = {r.doc_id: r for r in license_scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].labels) == (1, 2, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels) == (0, 0, None, "")
    assert got[4].base_labels == "apache-2,cc-by-nc" and got[4].last_word == 10
    assert (got[5].base_labels, got[5].labels, got[5].score) == ("", "gpl-3", 1.0)
    assert got[3].labels == "" and got[6].labels == "mit"  # a block may hold line feeds


BSD = ("Redistribution and use in source and binary forms, with or without modification, are "
       "permitted provided that the following conditions are met")


def brute_labels(text):
    """Labels of every run of words with enough of a notice, without lesser variants."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                   re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for label, notice in L.templates(L.NOTICES):
        words, n = set(notice.split()), L.block_words(len(notice.split()), L.THRESHOLD)
        for i in range(len(w)):
            at = [j for j in range(i, min(i + n, len(w))) if w[j] in words]
            found = len({w[j] for j in at})
            if w[i] in words and found >= L.needed(len(words), L.THRESHOLD):
                hits.append((label, found / len(words), i, at[-1]))
    kept = [a for a in hits if not any(
        b[0] != a[0] and b[1] > a[1]
        and 2 * (min(a[3], b[3]) - max(a[2], b[2]) + 1) > a[3] - a[2] + 1 for b in hits)]
    return ",".join(sorted({a[0] for a in kept})), max((a[1] for a in kept), default=0.0)


def test_license_blocks(spark):
    notices = [text for _, text in L.templates(L.NOTICES)]
    rng = random.Random(5)
    texts = [BSD.replace(" binary", "\nbinary"),  # over two lines
             "Released under the MIT license. " + BSD.replace("source", "any"),  # two on one line
             " ".join(notices), "\n".join(notices), None, "", "license " * 300,
             "x " * 5000 + notices[1] + " y" * 5000]
    for _ in range(60):
        w = " ".join(rng.sample(notices, 2)).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(["other", "license", "the"])
        if rng.random() < .4:
            w.insert(rng.randrange(len(w)), "more words here")
        texts.append(rng.choice([" ", "\n", ", "]).join(w))
    schema = "doc_id long, text string, labels string, word long, n long"
    rows = [(i, t, "clash", None, 1) for i, t in enumerate(texts)]
    got = license_scan(spark.createDataFrame(rows + rows[:2], schema)).collect()
    assert len(got) == len(rows) + 2
    by = {r.doc_id: r for r in got}
    assert by[0].labels == "bsd" and by[1].labels == "bsd,mit"
    for i, t in enumerate(texts):
        labels, score = brute_labels(t)
        base = set(filter(None, by[i].base_labels.split(",")))
        assert set(filter(None, by[i].labels.split(","))) == base | set(filter(None, labels.split(",")))
        assert by[i].score == (1.0 if by[i].n_base else score)


def test_url_lists(spark):
    events = spark.createDataFrame([("spam", "a.com", 5, "add"), ("spam", "a.com", 9, "remove"),
                                    ("adult", "x.a.com", 7, "add"), ("adult", None, 1, "add")],
                                   "list string, pattern string, day long, action string")
    captures = spark.createDataFrame([(1, "x.a.com", 4), (2, "x.a.com", 5), (3, "x.a.com", 8),
                                      (4, "x.a.com", 9), (5, "ba.com", 6), (6, None, 6)],
                                     "page_id long, host string, day long")
    got = {r.page_id: r.lists for r in listed(captures, events).collect()}
    assert got == {1: "", 2: "spam", 3: "adult,spam", 4: "adult", 5: "", 6: ""}


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [(-1, None), (-2, "")], []
    for i in range(900):
        w = [f"w{rng.randrange(300)}" for _ in range(30)]
        bad = i % 5 == 0
        for k in range(3 * bad):
            w[9 * k] = rng.choice(["grum", "snarf", "blorp"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity_scores(docs, spark.createDataFrame(
        labels, "doc_id long, toxic int")).collect()}
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i], y) for i, y in labels if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r, _ in held)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    none = toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in none.collect()} == {0.0}


def test_repeated_passages_at_any_line_breaks(spark):
    rng = random.Random(17)

    def prose(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def lines_of(w, n):
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    p = prose(60)
    head, tail = prose(70), prose(70)
    rows = [(1, " ".join(prose(70) + p + prose(70))),  # inside a line of 200 words
            (2, " ".join(head + p + tail)),  # glued into another line
            (3, "Title\n" + lines_of(p, 12)),  # wrapped into short lines
            (4, " ".join(prose(5) + p[:49])), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    removed = repeated_paragraphs(frame)
    got = {(r.doc_id, r.first_word, r.n_words, r.kept_doc_id) for r in removed.collect()}
    assert {(2, 70, 60, 1), (3, 1, 60, 1)} <= got and not [x for x in got if x[0] in (1, 5)]
    left = {r.doc_id: r.text for r in cut_paragraphs(frame, removed).collect()}
    assert left[1] == rows[0][1] and left[2].split() == head + tail and left[3] == "Title"
    # any common run of PASSAGE_WORDS words keeps a common window
    n = paragraphs.PASSAGE_WORDS
    for _ in range(200):
        run = rng.sample(range(2**40), n)
        sides = [np.array(rng.sample(range(2**40), rng.randrange(40)) + run
                          + rng.sample(range(2**40), rng.randrange(40)), np.uint64)
                 for _ in range(2)]
        a, b = (set(paragraphs.winnowed(h, np.zeros(len(h), int))[1].tolist()) for h in sides)
        assert a & b


def test_all_links_equal_brute_force(docs, empty, monkeypatch):
    assert ngram_join.ngram_link_counts(empty).count() == 0
    sets = {i: shingles(t) for i, t in enumerate(_texts())}
    linked = collections.Counter()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            linked[a] += a != b and both > 0 and 5 * both >= 4 * len(sets[a] | sets[b])
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)  # several blocks in a component
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_link_counts(docs).collect()}
    assert got == {i: linked[i] for i in sets} and max(got.values()) > 7
    rows = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "test")
    classes = scratch.store(ngram_join.shingle_classes(rows), "classes")
    links, _ = ngram_join.ngram_links(rows.select("text"), classes, scratch, Similarity())
    different = {frozenset(s) for s in sets.values() if s}
    want = sum(5 * len(a & b) >= 4 * len(a | b) for a in different for b in different if a != b)
    assert links.count() == links.distinct().count() == want // 2


def _edited(rng, item, kind):
    w = list(item)
    for _ in range(len(item) // 5):
        at = rng.randrange(len(w))
        if kind == "replaced":
            w[at] = f"e{rng.randrange(10**9)}"
        elif kind == "deleted":
            del w[at]
        else:
            w.insert(at, f"e{rng.randrange(10**9)}")
    return w


def test_decontamination_recall_at_every_length(spark):
    rng = random.Random(23)

    def prose(n):
        return [f"p{rng.randrange(10**6)}" for _ in range(n)]

    rows, items, kinds = [], [], ["replaced", "deleted", "inserted"]
    for m in (15, 59, 120, 200, 400, 800):
        for _ in range(40 if m < 100 else 8):
            items.append((len(items), prose(m)))
            for kind in kinds:
                rows.append((len(items) * 3 + kinds.index(kind) - 3, " ".join(
                    prose(80) + _edited(rng, items[-1][1], kind) + prose(80))))
    found = contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items],
                              "item_id long, text string")).collect()
    assert all(r.doc_id // 3 == r.item_id and 5 * r.distance <= len(items[r.item_id][1])
               for r in found)
    hit = {r.doc_id for r in found}
    for m in {len(w) for _, w in items}:
        for k, kind in enumerate(kinds):
            of = [3 * i + k in hit for i, w in items if len(w) == m]
            assert sum(of) >= 0.95 * len(of), (m, kind)


def test_decontamination_at_text_ends_and_of_short_items(spark):
    rng = random.Random(29)
    items = [[f"s{i}x{rng.randrange(10**6)}" for _ in range(n)] for i, n in enumerate((30, 12, 3))]
    rows = [(0, items[0][:9] + items[0][10:]), (1, ["so", *items[1][1:]]), (2, items[1][:-2]),
            (3, ["a", *items[2], "b"]), (4, [items[2][0], "z", *items[2][1:]]),
            (5, ["a", "b", *items[0][:12], *items[0][18:], "c", "d"]), (6, items[0][:23])]
    found = contaminated(
        spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)],
                              "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == {
        (0, 0, 1), (1, 1, 1), (2, 1, 2), (3, 2, 0), (5, 0, 6)}
    # candidates of which none is verified
    half = spark.createDataFrame([(1, " ".join(items[0][:22] + rows[5][1][:2] * 9))],
                                 "doc_id long, text string")
    assert contaminated(half, spark.createDataFrame([(0, " ".join(items[0]))],
                                                    "item_id long, text string")).count() == 0


def test_toxicity_without_training_texts(spark, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 60)],
                                   "doc_id bigint, quality int, toxic int")
    assert toxicity_scores(empty, labels).count() == 0
    other = spark.createDataFrame([(10**6 + i, f"text {i}", None, "s", None, "k", 1)
                                   for i in range(7)], DOCS)
    for got in (toxicity_scores(other, labels), toxicity_scores(other, labels.limit(0))):
        assert [(r.score, r.predicted) for r in got.collect()] == [(0.0, 0)] * 7
    # one text of each class only: every step learns from both
    few = spark.createDataFrame([(i, ("you vile fool " if i % 2 else "a calm day ") * 5, None, "s",
                                  None, "k", 1) for i in range(1, 4)], DOCS)
    assert toxicity_scores(few, labels).count() == 3


def test_url_hosts_and_odd_captures(spark, empty):
    urls = {"http://user:pw@bad.com/x": "bad.com", "http://u@bad.com/": "bad.com",
            "http://bad.com./x": "bad.com", "//bad.com/x": "bad.com", "HTTPS://A.Bad.com:80?q": "a.bad.com",
            "http://bad.com": "bad.com", "http://a@b@bad.com#f": "bad.com", "mailto:x@bad.com": None,
            "": None, None: None, "http:///x": None}
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)],
                                  "page_id long, url string, html string, host string")
    got = {r.page_id: r.host for r in page_captures(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    twice = listed(page_captures(pages.union(pages)), page_list_events(pages)).collect()
    assert len(twice) == 2 * len(urls)
    none = pages.limit(0)
    assert listed(page_captures(none), page_list_events(pages)).count() == 0
    assert not any(r.blocked for r in listed(page_captures(pages), page_list_events(none)).collect())
