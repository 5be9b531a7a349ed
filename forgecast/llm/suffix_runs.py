"""Byte-level substring deduplication by a distributed merge sort of suffixes.

A window is ``WINDOW`` bytes of one text; windows that start anywhere else too are
removed. Not every suffix has to be sorted for that: the anchor of a window is the
first of the least ``SEED``-byte hashes that start among its first ``REACH`` + 1 bytes.
It depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets, and one suffix per anchor stands for a range of windows.

1. ``anchors``: one row per anchor with its range of offsets and a hash of the ``CORE``
   bytes from it on, which all its windows hold. Anchors whose core occurs once go:
   nothing they could be compared with exists (the duplicate detection that finds
   distinguishing prefixes before strings are exchanged).
2. Runs: each task sorts its suffixes (cut where its windows end), merges equal ones
   to one entry with its members, front-codes the sorted run (the length of the prefix
   shared with the entry before, and the rest) and sends it out by core.
3. Merge: the task of a range of cores combines its runs with a loser tree that keeps
   with every string the length of the prefix it shares with the last winner. Longer
   shared prefixes win without a look at the bytes, equal ones are compared behind the
   prefix only. The result is the sorted order and its LCP array.
4. A window at offset o of an entry is repeated if another entry lies within LCP
   ``WINDOW`` - o of it and has the same o bytes before the anchor, or if the entry has
   several members. The least and greatest such o give the bytes to remove.

A core with more than ``HOT_ENTRIES`` anchors in different texts would make an unbounded
group in step 3. The windows of such cores are counted by hash (core, offset, bytes), a
partial aggregation, and joined back to their anchors; the result is the same.

Defined cases: a null text is empty; texts under ``WINDOW`` bytes keep everything;
repeated rows are copies of each other; null and repeated ids don't matter (rows with
equal texts have equal results); an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.llm.graph import Scratch, shuffle_partitions

WINDOW = 400
#: greatest distance of an anchor from the start of its window
REACH = 304
CORE = WINDOW - REACH
SEED = 32
#: bytes of the strings of one run
RUN_BYTES = 24 << 20
#: entries of whole cores that are resolved together
BATCH_ENTRIES = 20_000
#: bytes of the entries of one core that are merged in one task, and entries that fit
CORE_BYTES = 64 << 20
HOT_ENTRIES = CORE_BYTES // (WINDOW + REACH)

_U = np.uint64
_INDEX = _U(0xFFFFFFFF)
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_HEAD = np.dtype([("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2"), ("members", "<i4"),
                  ("copies", "<i8")])
_MEMBER = np.dtype([("key", "V16"), ("at", "<i4")])


def _rolling(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the byte hash and the powers that shift them back."""
    up, down = K._POWERS.get(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(K.EXACT[buf] * up[:len(buf)], out=c[1:])
    return c, down


def _hashes(rolling: tuple[np.ndarray, np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each start on."""
    c, down = rolling
    return K.mix((c[starts + n] - c[starts]) * down[starts] + _U(n))


def _anchors(t: K.Texts) -> tuple[np.ndarray, ...]:
    """Row, place, least and greatest offset and core hash of the anchors of a slice."""
    n = len(t.buf) - WINDOW + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    rolling = _rolling(t.buf)
    at = np.arange(n + REACH, dtype=np.int64)
    # the least hash, then the first place: one 64-bit minimum
    x = (_hashes(rolling, at, SEED) & ~_INDEX) | at.astype(np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    x = np.minimum(x[:n], x[REACH + 1 - width:][:n])
    anchor = (x & _INDEX).astype(np.int64)
    row = np.repeat(np.arange(t.rows), np.diff(t.offs))[:n]
    inside = np.flatnonzero(np.arange(n) + WINDOW <= t.offs[row + 1])
    if not len(inside):
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    a, r = anchor[inside], row[inside]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])]))
    last = np.append(head[1:], len(a)) - 1
    place = a[head]
    return (r[head], place - t.offs[r[head]], place - inside[last], place - inside[head],
            _hashes(rolling, place, CORE))


_ANCHOR = "key binary, at int, near int, far int, core bigint"


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0)
        for lo, t in K.slices(batch.column(1)):
            row, at, near, far, core = _anchors(t)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(lo + row)), *(pa.array(x, pa.int32()) for x in (at, near, far)),
                 pa.array(K.signed(core))], names=["key", "at", "near", "far", "core"])


def _common(x: bytes, y: bytes, h: int) -> int:
    """Length of the common prefix, of which h bytes are known."""
    n = min(len(x), len(y))
    while h < n:
        k = min(n, h + 48)
        apart = int.from_bytes(x[h:k]) ^ int.from_bytes(y[h:k])
        if apart:
            return h + (8 * (k - h) - apart.bit_length()) // 8
        h = k
    return n


class _Run:
    """Entries of one task, by core: suffix and bytes before the anchor -> members."""

    def __init__(self) -> None:
        self.found: dict[tuple[int, bytes, bytes], dict[tuple[bytes, int], int]] = {}
        self.bytes = 0

    def add(self, part: int, suffix: bytes, left: bytes, key: bytes, at: int,
            copies: int) -> None:
        entry = (part, suffix, left)
        members = self.found.get(entry)
        if members is None:
            members = self.found[entry] = {}
            self.bytes += len(suffix) + len(left) + 200
        members[key, at] = copies
        self.bytes += 40

    def packs(self) -> Iterator[pa.RecordBatch]:
        """One row per range of cores: the front-coded sorted run."""
        order = sorted(self.found)
        lo = 0
        while lo < len(order):
            hi = lo
            while hi < len(order) and order[hi][0] == order[lo][0]:
                hi += 1
            head = np.zeros(hi - lo, dtype=_HEAD)
            body, members, before = [], [], b""
            for i, entry in enumerate(order[lo:hi]):
                _, suffix, left = entry
                mine = self.found[entry]
                h = _common(before, suffix, 0)
                head[i] = (h, len(suffix) - h, len(left), len(mine), sum(mine.values()))
                body += [suffix[h:], left]
                members += mine
                before = suffix
            who = np.zeros(len(members), dtype=_MEMBER)
            who["key"] = np.frombuffer(b"".join(k for k, _ in members), dtype="V16")
            who["at"] = [at for _, at in members]
            yield pa.RecordBatch.from_arrays(
                [pa.array([order[lo][0]], pa.int32()), pa.array([head.tobytes()], pa.binary()),
                 pa.array([b"".join(body)], pa.binary()), pa.array([who.tobytes()], pa.binary())],
                names=["part", "head", "body", "members"])
            lo = hi


_PACK = "part int, head binary, body binary, members binary"


def _listed(wanted: pa.ListArray, row: int) -> list[list]:
    """Columns of one row's list of structs."""
    return [x.to_pylist() for x in wanted[row].values.flatten()]


def _run_batches(ranges: int):
    """Sorted, front-coded runs of the wanted anchors of (key, text, wanted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Run()
        for batch in batches:
            keys, texts, wanted = (batch.column(i) for i in range(3))
            for row in range(batch.num_rows):
                raw, key = texts[row].as_buffer().to_pybytes(), keys[row].as_py()
                for at, near, far, core, copies in zip(*_listed(wanted, row), strict=True):
                    now.add((core & 0xFFFFFFFF) % ranges, raw[at:at - near + WINDOW],
                            raw[at - far:at], key, at, copies)
                if now.bytes > RUN_BYTES:
                    yield from now.packs()
                    now = _Run()
        yield from now.packs()
    return run


class _Reader:
    """The entries of one front-coded run, one after another."""

    def __init__(self, number: int, head: bytes, body: bytes) -> None:
        self.number = number
        self.head = np.frombuffer(head, dtype=_HEAD).tolist() if head else []
        self.body = body
        self.next = self.place = self.member = 0
        self.suffix: bytes | None = b""
        self.lcp = 0  # with the last winner of the tree above this run
        self.step()

    def step(self) -> None:
        if self.next == len(self.head):
            self.suffix = None
            return
        self.lcp, rest, left, self.members, self.copies = self.head[self.next]
        cut = self.place + rest
        self.suffix = self.suffix[:self.lcp] + self.body[self.place:cut]
        self.place = cut + left
        self.left = self.body[cut:self.place]
        self.first, self.member = self.member, self.member + self.members
        self.next += 1


def _beats(a: _Reader, b: _Reader) -> bool:
    """Whether a's string comes first; the loser's ``lcp`` is then the one with the winner.

    Both ``lcp`` are with the last winner, which neither string precedes.
    """
    if a.suffix is None or b.suffix is None:
        return b.suffix is None
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    h = _common(a.suffix, b.suffix, a.lcp)
    first = a.suffix[h:h + 1] <= b.suffix[h:h + 1]
    (b if first else a).lcp = h
    return first


def merged(runs: list[_Reader]) -> Iterator[_Reader]:
    """Runs at their entries in sorted order; ``lcp`` is the one with the entry before."""
    size = 1
    while size < len(runs):
        size *= 2
    done = _Reader(-1, b"", b"")
    for r in runs:
        r.lcp = 0
    losers: list[_Reader] = [done] * size
    level = [*runs, *([done] * (size - len(runs)))]
    base = size
    while len(level) > 1:
        base //= 2
        winners = []
        for k in range(0, len(level), 2):
            a, b = level[k], level[k + 1]
            if not _beats(a, b):
                a, b = b, a
            winners.append(a)
            losers[base + k // 2] = b
        level = winners
    best = level[0]
    leaf = {id(r): size + i for i, r in enumerate(runs)}
    while best.suffix is not None:
        yield best
        best.step()
        node = leaf[id(best)] // 2
        while node:
            if not _beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


def repeated_offsets(lcp: np.ndarray, lefts: list[bytes], near: np.ndarray,
                     copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of a repeated window of each sorted entry (-1: none)."""
    n = len(lcp)
    far = np.fromiter((len(x) for x in lefts), np.int64, n)
    before = np.zeros((n, int(far.max()) + 1 if n else 1), dtype=np.uint8)
    flat = np.frombuffer(b"".join(x[::-1] for x in lefts), np.uint8)
    ends = np.cumsum(far)
    before[np.repeat(np.arange(n), far), np.arange(len(flat)) - np.repeat(ends - far, far)] = flat
    h = np.zeros(n, dtype=np.uint64)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    # entries that share too little with their neighbours have no partner at any offset
    most = np.maximum(lcp, np.append(lcp[1:], 0))
    alive = (most >= WINDOW - far) | (copies > 1)
    for o in range(before.shape[1]):
        if o:
            h = (h + before[:, o - 1]) * _MULTIPLIER + _U(1)
        at = np.flatnonzero(alive & (near <= o) & (far >= o))
        if not len(at):
            continue
        group = np.cumsum(lcp < WINDOW - o)[at].astype(np.uint64)
        key = K.mix(h[at] ^ K.mix(group * _MULTIPLIER + _U(o)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = copies[at[order]] > 1
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order][twice]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


_RANGE = "key binary, lo int, hi int"


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges to remove, from all runs of a range of cores."""
    runs, members = [], []
    for b in batches:
        for i in range(b.num_rows):
            runs.append(_Reader(len(runs), b.column(1)[i].as_py(), b.column(2)[i].as_py()))
            members.append(np.frombuffer(b.column(3)[i].as_py(), dtype=_MEMBER))
    lcp: list[int] = []
    lefts: list[bytes] = []
    rest: list[tuple[int, int, int, int, int]] = []

    def resolve() -> Iterator[pa.RecordBatch]:
        if not lcp:
            return
        near, copies, run, first, count = np.array(rest, dtype=np.int64).T
        shared = np.array(lcp, dtype=np.int64)
        shared[0] = 0
        low, high = repeated_offsets(shared, lefts, near, copies)
        hit = np.flatnonzero(high >= 0)
        who = [members[run[i]][first[i]:first[i] + count[i]] for i in hit]
        if who:
            all_ = np.concatenate(who)
            entry = np.repeat(hit, count[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(16), len(all_), [None, pa.py_buffer(all_["key"].tobytes())]
                ).cast(pa.binary()),
                 pa.array(all_["at"] - high[entry], pa.int32()),
                 pa.array(all_["at"] - low[entry] + WINDOW, pa.int32())],
                names=["key", "lo", "hi"])

    for r in merged(runs) if runs else ():
        if len(lcp) >= BATCH_ENTRIES and r.lcp < CORE:
            yield from resolve()
            lcp, lefts, rest = [], [], []
        lcp.append(r.lcp)
        lefts.append(r.left)
        rest.append((WINDOW - len(r.suffix), r.copies, r.number, r.first, r.members))
    yield from resolve()


_HOT = "core bigint, apart int, window bigint, key binary, at int, copies bigint"


def _hot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the wanted anchors by core, offset and hash."""
    for batch in batches:
        keys, wanted = batch.column(0), batch.column(2)
        for lo, t in K.slices(batch.column(1)):
            rolling = _rolling(t.buf)
            for row in range(t.rows):
                if not len(wanted[lo + row]):
                    continue
                at, near, far, core, copies = (np.array(x, dtype=np.int64)
                                               for x in _listed(wanted, lo + row))
                many = far - near + 1
                apart = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(
                    near, many)
                place = np.repeat(at, many)
                h = _hashes(rolling, t.offs[row] + place - apart, WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(core, many)), pa.array(apart, pa.int32()),
                     pa.array(K.signed(h)),
                     pa.array([keys[lo + row].as_py()] * len(h), pa.binary()),
                     pa.array(place, pa.int32()), pa.array(np.repeat(copies, many))],
                    names=["core", "apart", "window", "key", "at", "copies"])


def _key() -> Column:
    return F.unhex(F.md5(F.col("text")))


def _beside(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Join texts with stored lists by key: the same sort-merge join at every size, whose
    partitions adaptive execution can split where one text has very many copies."""
    return texts.join(lists.hint("merge"), "key", how)


def repeated_ranges(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, lo, hi): bytes of texts (key, text) that lie in windows which occur elsewhere."""
    found = scratch.store(texts.mapInArrow(_anchor_batches, _ANCHOR)
                          .groupBy("key", "at", "near", "far", "core")
                          .agg(F.count("*").alias("copies")), "anchors")
    cores = scratch.store(found.groupBy("core").agg(
        F.sum("copies").alias("places"), F.count("*").alias("entries"))
        .where("places > 1").select("core", (F.col("entries") > HOT_ENTRIES).alias("hot")), "cores")
    one = F.struct("at", "near", "far", "core", "copies")
    wanted = scratch.store(found.join(cores, "core").groupBy("key", "hot").agg(
        F.sort_array(F.collect_list(one)).alias("wanted")), "wanted")
    scratch.drop("anchors")
    ranges = shuffle_partitions(texts.sparkSession)
    cold = _beside(texts, wanted.where("not hot"), "inner").select("key", "text", "wanted")
    packs = cold.mapInArrow(_run_batches(ranges), _PACK)
    out = packs.repartitionById(ranges, F.col("part")).mapInArrow(_merge_batches, _RANGE)
    if not cores.where("hot").isEmpty():
        hot = _beside(texts, wanted.where("hot"), "inner").select("key", "text", "wanted")
        windows = scratch.store(hot.mapInArrow(_hot_batches, _HOT), "windows")
        same = ["core", "apart", "window"]
        again = scratch.store(windows.groupBy(*same).agg(F.sum("copies").alias("n"))
                              .where("n > 1").select(*same), "again")
        hits = windows.join(again, same, "left_semi").groupBy("key", "at").agg(
            F.min("apart").alias("low"), F.max("apart").alias("high"))
        out = out.union(hits.select("key", F.col("at") - F.col("high"),
                                    F.col("at") - F.col("low") + WINDOW))
    return out


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes, removed bytes, maximal removed runs and the hash of what is kept."""
    for batch in batches:
        texts, gone = batch.column("text"), batch.column("gone")
        rows = []
        for i in range(batch.num_rows):
            raw = memoryview(texts[i].as_buffer()) if texts[i].is_valid else memoryview(b"")
            h, end, removed, spans = hashlib.sha256(), 0, 0, 0
            for lo, hi in zip(*_listed(gone, i), strict=True) if gone[i].is_valid else ():
                if lo > end or not spans:
                    h.update(raw[end:lo])
                    spans += 1
                    end = lo
                if hi > end:
                    removed += hi - end
                    end = hi
            h.update(raw[end:])
            rows.append((len(raw), removed, spans, h.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
             pa.array([r[3] for r in rows], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    keyed = rows.withColumn("key", _key())
    long = keyed.where(F.octet_length("text") >= WINDOW).select("key", "text")
    gone = scratch.store(repeated_ranges(long, scratch).groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("gone")), "gone")
    scratch.drop("cores", "wanted", "windows", "again")
    return (_beside(keyed, gone, "left").select("doc_id", "text", "gone")
            .mapInArrow(_cut_batches, "doc_id bigint, n_bytes bigint, n_removed bigint, "
                        "n_spans bigint, kept_sha256 string"))
