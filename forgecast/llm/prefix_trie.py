"""Prefix trie of conversations: union-find over the LCP edges of sorted neighbours.

1. Each turn becomes a 16-byte digest of (role, text) and the length of its text, so
   texts aren't shuffled. A conversation is the concatenation of its turns' digests:
   byte order of these keys keeps equal prefixes together.
2. Keys are range-partitioned and sorted. ``_forest`` takes one partition's rows (in
   order) as items and the common prefix length of each two neighbours as an edge.
   Depths are visited from the deepest up: an item becomes a component at its own
   depth, an edge joins two components, and every join of components makes (or
   enlarges) a branching node. A component that is taken to a smaller depth leaves a
   chain of nodes with one child behind.
3. Nodes that hold neither the partition's first nor its last item are complete.
   The others are contracted to one weighted item per node (its part of the counts,
   without children that are open too), and step 2 runs again over these few items,
   ``OPEN_ITEMS`` to a partition, until one partition holds all.
4. A node's parent may close in a later round only; those rounds' nodes are joined by
   the prefix's digest. Conversations that end at an open node arrive as runs of ids
   in order and are hashed as a stream, so a node with very many copies needs no
   memory for them.

A conversation is one row (36 bytes a turn). Defined cases: turns are ordered by turn,
null first, then by digest; null role and text are empty; turns without a conv_id
belong to no conversation; repeated turns are turns; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgecast.llm.graph import Scratch, join_ids, shuffle_partitions

#: conversations of a hundred share first turns with the one that begins it
HUNDRED = 100
BORROWED = 6
TURN_BYTES = 16
#: contracted items of a partition in the rounds after the first
OPEN_ITEMS = 50_000
#: ids of one run of conversations that end at an open node
RUN_IDS = 4096

NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
_ITEM = ("key binary, conv_id bigint, n bigint, kids bigint, leaves bigint, saved bigint, "
         "tokens array<int>")
#: what a forest step returns: a complete node, an open item or a run of ids
_STEP = f"kind string, id binary, parent_id binary, {_NODE}, {_ITEM.replace('conv_id', 'least')}, ids string"


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from the one its hundred begins with."""
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("int")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation: ordered (turn, digest, tokens) structs."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return (turns.where("conv_id is not null")
            .select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                    F.substring(F.unhex(F.sha2(framed, 256)), 1, TURN_BYTES).alias("digest"),
                    F.length(text).alias("tokens"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list(
                F.struct("turn", "digest", "tokens"))).alias("turns")))


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, key, tokens) of every rebuilt conversation."""
    whole = scratch.store(sequences(turns), "sequences")
    first = whole.where(F.col("conv_id") % HUNDRED == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, BORROWED - 1).alias("lent"))
    h = borrowed(F.col("conv_id"))
    lent = F.coalesce(F.slice("lent", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h,
                                                                         F.lit(0))))
    both = F.concat(lent, F.coalesce(own, F.slice("turns", 1, 0)))
    return (whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
            .join(first, "base", "left").withColumn("both", both)
            .select("conv_id", F.unhex(F.array_join(F.transform("both", lambda t: F.hex(t["digest"])),
                                                    "")).alias("key"),
                    F.col("both.tokens").alias("tokens")))


class _Items:
    """The items of one partition, in key order."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.keys: list[bytes] = []
        self.tokens: list[list[int]] = []
        self.weights: list[tuple[int, int, int, int, int]] = []
        for b in batches:
            key, conv, n, kids, leaves, saved, tokens = (b.column(i).to_pylist() for i in range(7))
            self.keys += key
            self.tokens += tokens
            self.weights += zip(n, conv, kids, leaves, saved, strict=True)

    def depth(self, i: int) -> int:
        return len(self.keys[i]) // TURN_BYTES

    def common(self, i: int) -> int:
        """Turns that item i and the next one begin with."""
        a, b = self.keys[i], self.keys[i + 1]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n // TURN_BYTES
        x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
        return int(np.argmax(x != y)) // TURN_BYTES


class _Component:
    """Neighbouring items with a common prefix, and the node at its current depth.

    ``kids``, ``leaves`` and ``saved`` count what is below that node; ``below`` are
    records of its children, whose parent is known when the node is left.
    """

    __slots__ = ("lo", "hi", "depth", "n", "least", "kids", "leaves", "saved", "below", "ends")

    def __init__(self, i: int, depth: int, weight: tuple[int, int, int, int, int]) -> None:
        self.lo = self.hi = i
        self.depth, self.ends = depth, (i, i + 1)
        self.n, self.least, self.kids, self.leaves, self.saved = weight
        self.below: list[int] = []

    def join(self, other: _Component) -> None:
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        self.n += other.n
        self.least = min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.below += other.below
        # items that end at this node follow one another: they are the component's first
        ends = [c.ends for c in (self, other) if c.ends]
        self.ends = (min(e[0] for e in ends), max(e[1] for e in ends)) if ends else None


def _prefix_id(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[:depth * TURN_BYTES]).digest()[:TURN_BYTES] + depth.to_bytes(4, "big")


class _Forest:
    """Nodes of the trie of one partition's items.

    ``whole``: the items are all there are, so that every node is complete. ``first``:
    items are conversations (one id each), not contracted nodes.
    """

    def __init__(self, items: _Items, whole: bool, first: bool) -> None:
        self.items, self.whole, self.first = items, whole, first
        self.rows: list[dict] = []

    def leave(self, c: _Component) -> None:
        """Record the node at which ``c`` stands."""
        it, key = self.items, self.items.keys[c.lo]
        open_ = not self.whole and (c.lo == 0 or c.hi == len(it.keys) - 1)
        tokens = it.tokens[c.lo][c.depth - 1] if c.depth else 0
        # children that are open too are items of the next round themselves
        for child in c.below:
            if self.rows[child]["kind"] == "node":
                self.rows[child]["parent_conv_id"] = None if open_ else c.least
                self.rows[child]["parent_id"] = _prefix_id(key, c.depth) if open_ else None
        row: dict = {"depth": c.depth}
        if open_:
            shut = [self.rows[x] for x in c.below if self.rows[x]["kind"] == "node"]
            n, least, kids, leaves, saved = self.own(c, shut)
            row |= {"kind": "open", "key": key[:c.depth * TURN_BYTES], "least": least, "n": n,
                    "kids": kids, "leaves": leaves, "saved": saved,
                    "tokens": it.tokens[c.lo][:c.depth]}
            if self.first and c.ends:
                self.runs(c, _prefix_id(key, c.depth))
        else:
            c.leaves = c.leaves if c.kids else 1
            c.saved += (c.n - 1) * tokens
            row |= {"kind": "node", "conv_id": c.least, "n_convs": c.n, "n_children": c.kids,
                    "n_leaves": c.leaves, "saved_tokens": c.saved,
                    "id": None if self.first else _prefix_id(key, c.depth),
                    "ends_sha256": self.hashed(c.ends) if self.first else None}
        c.below = [len(self.rows)]
        self.rows.append(row)

    def own(self, c: _Component, shut: list[dict]) -> tuple[int, int | None, int, int, int]:
        """An open node's counts without its open children: own items and complete children."""
        mine = [self.items.weights[i] for i in range(*c.ends)] if c.ends else []
        ids = [w[1] for w in mine if w[1] is not None] + [r["conv_id"] for r in shut]
        return (sum(w[0] for w in mine) + sum(r["n_convs"] for r in shut),
                min(ids) if ids else None,
                sum(w[2] for w in mine) + len(shut),
                sum(w[3] for w in mine) + sum(r["n_leaves"] for r in shut),
                sum(w[4] for w in mine) + sum(r["saved_tokens"] for r in shut))

    def hashed(self, ends: tuple[int, int] | None) -> str:
        h = hashlib.sha256()
        for k, i in enumerate(range(*ends) if ends else ()):
            h.update((b"," if k else b"") + str(self.items.weights[i][1]).encode())
        return h.hexdigest()

    def runs(self, c: _Component, node: bytes) -> None:
        for lo in range(c.ends[0], c.ends[1], RUN_IDS):
            ids = [self.items.weights[i][1] for i in range(lo, min(lo + RUN_IDS, c.ends[1]))]
            self.rows.append({"kind": "ids", "id": node, "least": ids[0],
                              "ids": ",".join(map(str, ids))})

    def raise_to(self, c: _Component, depth: int) -> None:
        """Leave the nodes of ``c`` below ``depth``; ``c`` then stands at ``depth``."""
        while c.depth > depth:
            self.leave(c)
            c.depth, c.kids, c.ends = c.depth - 1, 1, None

    def build(self) -> list[dict]:
        it = self.items
        m = len(it.keys)
        if not m:
            return []
        at: dict[int, tuple[list[int], list[int]]] = {}
        for i in range(m):
            at.setdefault(it.depth(i), ([], []))[0].append(i)
            if i + 1 < m:
                at.setdefault(it.common(i), ([], []))[1].append(i)
        up = list(range(m))
        comp: list[_Component | None] = [None] * m

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for depth in sorted(at, reverse=True):
            items, edges = at[depth]
            for i in items:
                w = it.weights[i]
                comp[i] = _Component(i, depth, (w[0], math.inf if w[1] is None else w[1], *w[2:]))
            for i in edges:
                a, b = find(i), find(i + 1)
                self.raise_to(comp[a], depth)
                self.raise_to(comp[b], depth)
                comp[a].join(comp[b])
                up[b], comp[b] = a, None
        root = comp[find(0)]
        self.raise_to(root, 0)
        self.leave(root)
        return self.rows


_COLUMNS = [x.strip().split(" ") for x in _STEP.split(",")]
_TYPES = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(),
          "array<int>": pa.list_(pa.int32())}


def _forest(whole: bool, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Forest(_Items(batches), whole, first).build()
        for lo in range(0, len(rows), 8192):
            part = rows[lo:lo + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(c) for r in part], _TYPES[t]) for c, t in _COLUMNS],
                names=[c for c, _ in _COLUMNS])
    return run


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sha) of sorted (id, least, ids) rows, as a stream."""
    done: list[tuple[bytes, str]] = []
    node, h = None, None
    for b in batches:
        for i, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if i != node:
                if h is not None:
                    done.append((node, h.hexdigest()))
                node, h = i, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
    if h is not None:
        done.append((node, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()),
                                      pa.array([x for _, x in done], pa.string())],
                                     names=["id", "sha"])


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``_NODE``)."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    found = scratch.store(rebuilt(turns, scratch), "rebuilt")
    items = found.select("key", "conv_id", F.lit(1).cast("bigint").alias("n"),
                         *(F.lit(0).cast("bigint").alias(c) for c in ("kids", "leaves", "saved")),
                         "tokens")
    rounds: list[DataFrame] = []
    parts = shuffle_partitions(spark)
    while True:
        whole, first = parts == 1, not rounds
        order = ["key", "conv_id"]
        dealt = (items.coalesce(1) if whole else items.repartitionByRange(parts, *order))
        step = scratch.store(dealt.sortWithinPartitions(*order).mapInArrow(
            _forest(whole, first), _STEP), f"round-{len(rounds)}")
        rounds.append(step)
        items = step.where("kind = 'open'").select(
            "key", F.col("least").alias("conv_id"), "n", "kids", "leaves", "saved", "tokens")
        if whole:
            break
        # at most the two outer paths of every partition
        parts = min(parts - 1, math.ceil(items.count() / OPEN_ITEMS))
        if not parts:
            break
    columns = [c.split(" ")[0] for c in _NODE.split(", ")]
    nodes = rounds[0].where("kind = 'node'").select(*columns, "parent_id")
    if len(rounds) > 1:
        ids = rounds[0].where("kind = 'ids'").select("id", "least", "ids")
        ends = scratch.store(ids.repartition(parts, "id").sortWithinPartitions("id", "least")
                             .mapInArrow(_hash_runs, "id binary, sha string"), "ends")
        later = rounds[1].where("kind = 'node'")
        for step in rounds[2:]:
            later = later.union(step.where("kind = 'node'"))
        later = scratch.store(later.select("id", *columns, "parent_id").join(ends, "id", "left")
                              .withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING)))
                              .select("id", *columns, "parent_id"), "later")
        up = scratch.store(later.select(F.col("id").alias("parent_id"),
                                        F.col("conv_id").alias("up")), "up")
        nodes = nodes.union(later.select(*columns, "parent_id"))
        nodes = join_ids(nodes, up, "parent_id", "left").withColumn(
            "parent_conv_id", F.coalesce("parent_conv_id", "up"))
    return nodes.select(*columns)
