"""N-gram Jaccard join: texts whose 5-word shingle sets reach 0.8, their links and components.

1. ``shingle_classes``: texts with equal sets form one class, keyed by a hash
   of the set; copies cost one row each from here on.
2. Document frequencies: each task packs its classes' shingle hashes by hash
   range; one task per range sorts them, counts in how many classes each shingle
   occurs and returns to each class its shared shingles only, packed by class. A
   shingle of a single class can't be part of an overlap, so its number is enough.
3. Rare-first prefix: with u unshared shingles first and the shared ones by
   (frequency, hash), only the prefix of n - ceil(0.8 n) + 1 is indexed. The
   first u places hold no candidates.
4. ``graph.link`` joins on prefix shingles under the length, positional and
   suffix (parity bitmap) filters and verifies the pairs that decide the components.
5. Every link lies inside one component, so ``ngram_links`` and ``ngram_link_counts``
   verify all pairs of different classes of each component, block by block. A large
   component is many blocks of bounded size; copies are counted, never paired.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Defined cases: a null
or empty text has no shingles, no links and its own id as component; a row's
links are the other documents it reaches 0.8 with, its copies included, each id
once per set and each row without an id once; fewer
than five words make one shingle; repeated rows are one class; an empty table
gives an empty result; rows with a null id never lend their id to a component,
and keep a null component if no row of it has an id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.llm.graph import (
    Scratch,
    Similarity,
    components,
    join_ids,
    link,
    longs,
    shuffle_partitions,
)

SHINGLE_WORDS = 5
#: bytes kept of a shingle's hash besides its hash range's number
HASH_BYTES = 5
#: bits of the suffix filter's bitmap, in 64-bit columns
SKETCH_LONGS = 8
#: bytes of text whose classes are packed together
PACK_BYTES = 4 << 20
#: classes on each side of a block of pairs, and shingles of a block compared together
BLOCK_CLASSES = 128
BLOCK_SHINGLES = 1 << 12

_U = np.uint64
_LOW = _U((1 << (8 * HASH_BYTES)) - 1)


def _sets(t: K.Texts) -> tuple[K.Shingles, np.ndarray]:
    words = K.split_words(t, K.SPACES)
    s = K.shingle_sets(K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED), words.first,
                       SHINGLE_WORDS)
    return s, K.set_keys(s)


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, t in K.slices(batch.column(1)):
            s, keys = _sets(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, t.rows), pa.array(s.counts, pa.int64()),
                 pa.array(K.signed(keys), mask=s.counts == 0)], names=["doc_id", "n", "node"])


def shingle_classes(rows: DataFrame) -> DataFrame:
    """(doc_id, n, node) per row of (doc_id, text): set size and class key (null: empty set)."""
    return rows.mapInArrow(_class_batches, "doc_id bigint, n bigint, node bigint")


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _narrow(run: np.ndarray) -> np.ndarray:
    return run.astype(np.uint16 if len(run) and run.max() < 65536 else np.int32)


def _runs(raw: bytes, classes: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * classes else np.int32).astype(np.int64)


def _packer(ranges: int):
    """Per batch and hash range: class keys, shingles per class, hash bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in K.slices(batch.column(0), PACK_BYTES):
                s, keys = _sets_in_slices(t)
                if not len(s.hash):
                    continue
                # one copy of each class in this pack
                _, where = np.unique(keys, return_index=True)
                first = np.zeros(len(keys), dtype=bool)
                first[where] = True
                keep = (first & (s.counts > 0))[s.group]
                h, owner = s.hash[keep], s.group[keep]
                part = _range_of(h, ranges)
                order = np.argsort(part.astype(np.uint16 if ranges < 65536 else np.int64),
                                   kind="stable")
                h, owner, part = h[order], owner[order], part[order]
                # runs of one class inside one range
                head = np.flatnonzero(np.concatenate(
                    [[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
                run = _narrow(np.diff(np.append(head, len(h))))
                used, at = np.unique(part[head], return_index=True)
                classes = np.diff(np.append(at, len(head)))
                entries = np.add.reduceat(run, at, dtype=np.int64)
                raw = (h & _LOW).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()),
                     K.binary_column(keys[owner[head]], classes * 8),
                     K.binary_column(run, classes * run.itemsize),
                     K.binary_column(raw, entries * HASH_BYTES)],
                    names=["part", "nodes", "runs", "hashes"])
    return pack


def _sets_in_slices(t: K.Texts) -> tuple[K.Shingles, np.ndarray]:
    """Shingle sets of a large slice, taken in small ones to bound temporary arrays."""
    column = pa.Array.from_buffers(pa.large_string(), t.rows, [
        None, pa.py_buffer(np.ascontiguousarray(t.offs)), pa.py_buffer(t.buf)])
    found = [(lo, *_sets(x)) for lo, x in K.slices(column)]
    return K.Shingles(np.concatenate([s.hash for _, s, _ in found]),
                      np.concatenate([s.group + lo for lo, s, _ in found]),
                      np.concatenate([s.counts for _, s, _ in found])), \
        np.concatenate([k for _, _, k in found])


def _read_packs(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """Range number, class key and hash of every entry of a partition's packs."""
    out: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for i in range(batch.num_rows):
            part, node, run, raw = (batch.column(j)[i].as_py() for j in range(4))
            node = np.frombuffer(node, np.uint64)
            wide = np.zeros((len(raw) // HASH_BYTES, 8), dtype=np.uint8)
            wide[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
            for into, x in zip(out, (np.full(len(wide), part, dtype=np.int64),
                                     np.repeat(node, _runs(run, len(node))),
                                     wide.view(np.uint64).reshape(-1)), strict=True):
                into.append(x)
    return [np.concatenate(x) for x in out] if out[0] else None


def _size_packer(ranges: int):
    """Class keys and set sizes, packed by class range."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            size = batch.column(1).to_numpy().astype(np.int32)
            to = _range_of(K.mix(node), ranges)
            order = np.argsort(to, kind="stable")
            used, at = np.unique(to[order], return_index=True)
            classes = np.diff(np.append(at, len(node)))
            empty = pa.nulls(len(used), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), K.binary_column(node[order], classes * 8),
                 K.binary_column(size[order], classes * 4), empty, empty],
                names=["part", "nodes", "runs", "hashes", "dfs"])
    return pack


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal rows begins (columns sorted together)."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counter(ranges: int):
    """All packs of one hash range: shared shingles with frequencies, packed by class range."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read_packs(batches)
        if read is None:
            return
        part, node, h = read
        h = h | (part.astype(np.uint64) << _U(8 * HASH_BYTES))
        order = np.argsort(h)
        hs = h[order]
        same = np.zeros(len(hs) + 1, dtype=bool)
        same[1:-1] = hs[1:] == hs[:-1]
        order = order[same[1:] | same[:-1]]  # shingles that occur twice at least
        del hs, part
        h, node = h[order], node[order]
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        one = _heads(h, node)  # one entry per class, however many packs
        h, node = h[one], node[one]
        start = _heads(h)
        df = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
        keep = df > 1
        h, node, df = h[keep], node[keep], df[keep].astype(np.int32)
        if not len(h):
            return
        to = _range_of(K.mix(node), ranges)
        order = np.lexsort((node, to))
        h, node, df, to = (x[order] for x in (h, node, df, to))
        head = _heads(to, node)
        run = _narrow(np.diff(np.append(head, len(h))))
        used, at = np.unique(to[head], return_index=True)
        classes = np.diff(np.append(at, len(head)))
        entries = np.add.reduceat(run, at, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), K.binary_column(node[head], classes * 8),
             K.binary_column(run, classes * run.itemsize),
             K.binary_column(h, entries * 8), K.binary_column(df, entries * 4)],
            names=["part", "nodes", "runs", "hashes", "dfs"])
    return count


def _gatherer(sim: Similarity):
    """All packs of one class range: per class with enough shared shingles, these rarest
    first, the number of the unshared ones and the suffix-filter bitmap."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], []]
        known: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for i in range(batch.num_rows):
                node, run, h, df = (batch.column(j)[i].as_py() for j in range(1, 5))
                node = np.frombuffer(node, np.uint64)
                if h is None:
                    known[0].append(node)
                    known[1].append(np.frombuffer(run, np.int32))
                    continue
                for into, x in zip(cols, (np.repeat(node, _runs(run, len(node))),
                                          np.frombuffer(h, np.uint64),
                                          np.frombuffer(df, np.int32)), strict=True):
                    into.append(x)
        if not cols[0]:
            return
        node, h, df = (np.concatenate(x) for x in cols)
        classes, sizes_of = (np.concatenate(x) for x in known)
        order = np.argsort(classes)
        classes, sizes_of = classes[order], sizes_of[order]
        order = np.argsort(node, kind="stable")
        node, h, df = node[order], h[order], df[order]
        head = _heads(node)
        run = np.diff(np.append(head, len(node)))
        n = sizes_of[np.searchsorted(classes, node[head])].astype(np.int64)
        enough = run >= (n * sim.num + sim.den - 1) // sim.den
        keep = np.repeat(enough, run)
        node, h, df = node[keep], h[keep], df[keep]
        order = np.lexsort((h, df, node))
        h = h[order]
        key, n, run = K.signed(node[_heads(node)]), n[enough], run[enough]
        ends = np.concatenate([[0], np.cumsum(run)])
        for lo in range(0, len(key), 1024):
            hi = min(lo + 1024, len(key))
            flat, sizes = h[ends[lo]:ends[hi]], run[lo:hi]
            s = K.Shingles(flat, np.repeat(np.arange(hi - lo), sizes), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[lo:hi]), pa.array(n[lo:hi]), pa.array(n[lo:hi] - sizes),
                 K.list_column(K.signed(flat), sizes), *longs(K.parity_sketch(s, SKETCH_LONGS))],
                names=["node", "n", "u", "elements", *_SKETCH])
    return gather


_SKETCH = [f"s_{i}" for i in range(SKETCH_LONGS)]


def ranked_sets(rows: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """(node, n, u, elements, s_*) of every class that shares enough to have a partner.

    ``rows`` has the texts, ``classes`` their (node, n).
    """
    ranges = shuffle_partitions(rows.sparkSession)
    packs = rows.select("text").mapInArrow(
        _packer(ranges), "part int, nodes binary, runs binary, hashes binary")
    schema = "part int, nodes binary, runs binary, hashes binary, dfs binary"
    shared = packs.repartitionById(ranges, F.col("part")).mapInArrow(_counter(ranges), schema)
    sizes = (classes.where("node is not null").select("node", "n")
             .mapInArrow(_size_packer(ranges), schema))
    return (shared.union(sizes).repartitionById(ranges, F.col("part")).mapInArrow(
        _gatherer(sim), "node bigint, n bigint, u bigint, elements array<bigint>, "
        + ", ".join(f"{c} bigint" for c in _SKETCH)))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of common elements of sets."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    if not len(both):
        return out
    sides = []
    for flat, sets in ((a, left), (b, right)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        ok = both[at] == flat
        sides.append((owner[ok], at[ok]))
    for lo in range(0, len(both), BLOCK_SHINGLES):
        hi = min(lo + BLOCK_SHINGLES, len(both))
        m = []
        for (owner, at), sets in zip(sides, (left, right), strict=True):
            part = (at >= lo) & (at < hi)
            x = np.zeros((len(sets), hi - lo), dtype=np.float32)
            x[owner[part], at[part] - lo] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)  # whole numbers below 2**24
    return out


def _block_links(rows: list[tuple], sim: Similarity) -> tuple[list[list[tuple]], np.ndarray]:
    """Left and right rows of one block of pairs and which of them are linked."""
    i, j = rows[0][1:3]
    sides = [[r for r in rows if r[3] == b] for b in ((i,) if i == j else (i, j))]
    left, right = sides[0], sides[-1]
    if not left or not right:
        return [left, right], np.zeros((len(left), len(right)), dtype=bool)
    shared = _shared([r[7] for r in left], [r[7] for r in right])
    n = [np.array([r[5] for r in side]) for side in (left, right)]
    linked = sim.den * shared >= sim.num * (n[0][:, None] + n[1][None, :] - shared)
    if i == j:
        linked &= ~np.eye(len(left), dtype=bool)
    return [left, right], linked


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each (comp, i, j), which follow one another."""
    rows: list[tuple] = []
    for batch in batches:
        plain = [batch.column(k).to_pylist() for k in range(7)]
        for r in zip(*plain, (x.values.to_numpy().copy() for x in batch.column(7)), strict=True):
            if rows and rows[0][:3] != r[:3]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _pair_links(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            (left, right), linked = _block_links(rows, sim)
            x, y = (np.array([r[4] for r in side], dtype=np.int64) for side in (left, right))
            at, to = np.nonzero(linked)
            a, b = x[at], y[to]
            once = (a < b) if rows[0][1] == rows[0][2] else np.ones(len(a), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)[once]), pa.array(np.maximum(a, b)[once])],
                names=["a", "b"])
    return run


def _count_links(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            (left, right), linked = _block_links(rows, sim)
            copies = [np.array([r[6] for r in side], dtype=np.int64) for side in (left, right)]
            node, links = [r[4] for r in left], linked @ copies[1]
            if rows[0][1] != rows[0][2]:
                node += [r[4] for r in right]
                links = np.concatenate([links, copies[0] @ linked])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(links, pa.int64())],
                names=["node", "links"])
    return run


def _blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(comp, i, j, block, node, n, copies, elements), i <= j: every two members of a component
    meet in exactly one (comp, i, j). ``members`` (stored): comp, node, n, copies, elements."""
    spark = members.sparkSession
    large = scratch.store(members.groupBy("comp").agg(
        F.ceil(F.count("*") / BLOCK_CLASSES).alias("blocks")).where("blocks > 1"), "large")
    dealt = (join_ids(members, large, "comp", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return (dealt.withColumn("other", other)
            .select("comp", F.least("block", "other").alias("i"),
                    F.greatest("block", "other").alias("j"), "block", "node", "n", "copies",
                    "elements")
            .repartition(shuffle_partitions(spark), "comp", "i", "j")
            .sortWithinPartitions("comp", "i", "j"))


def _components(rows: DataFrame, classes: DataFrame, scratch: Scratch,
                sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """Stored sets of the classes of (text) rows, and the components they make."""
    ranked = scratch.store(ranked_sets(rows, classes, sim), "ranked")
    own = (sim.prefix_length(F.col("n")) - F.col("u")).cast("int")
    postings = scratch.store(
        ranked.where(own > 0).select("node", "n", "u",
                                     F.posexplode(F.slice("elements", 1, own)).alias("at", "key"))
        .select("key", "node", "n", "u", (F.col("u") + F.col("at")).alias("pos")), "postings")
    _, root = link(postings, ranked.select("node", *_SKETCH),
                   lambda nodes: ranked.join(nodes, "node", "left_semi"), sim, scratch)
    scratch.drop("postings")
    return ranked, root


def _members(ranked: DataFrame, root: DataFrame, copies: DataFrame,
             scratch: Scratch) -> DataFrame:
    """(comp, node, n, copies, elements) of the classes of components of two classes at least."""
    comp = scratch.store(root.select("node", F.col("root").alias("comp")).union(
        root.select("root", "root").distinct()).join(copies, "node"), "comp")
    return scratch.store(ranked.select("node", "n", "elements").join(comp, "node")
                         .select("comp", "node", "n", "copies", "elements"), "members")


def ngram_links(rows: DataFrame, classes: DataFrame, scratch: Scratch,
                sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """All links (a, b), a < b, between classes of (text) rows, and the components."""
    ranked, root = _components(rows, classes, scratch, sim)
    members = _members(ranked, root, _copies(classes), scratch)
    scratch.drop("ranked", "comp")
    return _blocks(members, scratch).mapInArrow(_pair_links(sim), "a bigint, b bigint"), root


def _copies(classes: DataFrame) -> DataFrame:
    """(node, copies): documents of each class, an id once, a row without an id once."""
    return (classes.where("node is not null").groupBy("node", "doc_id")
            .agg(F.count("*").alias("rows"))
            .groupBy("node").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows"))
                                       .otherwise(F.lit(1))).alias("copies")))


def ngram_link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      sim: Similarity | None = None) -> DataFrame:
    """(doc_id, n_links) for every row: the other documents that reach the threshold with it."""
    sim = sim or Similarity()
    scratch = Scratch(docs.sparkSession, "ngram-links")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    classes = scratch.store(shingle_classes(rows), "classes")
    copies = scratch.store(_copies(classes), "copies")
    ranked, root = _components(rows.select("text"), classes, scratch, sim)
    members = _members(ranked, root, copies, scratch)
    scratch.drop("ranked", "comp")
    links = scratch.store(_blocks(members, scratch).mapInArrow(
        _count_links(sim), "node bigint, links bigint").groupBy("node")
        .agg(F.sum("links").alias("links")), "links")
    total = scratch.store(copies.join(links, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "total")
    return (classes.join(total, "node", "left")
            .select("doc_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       sim: Similarity | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: least id reachable by links."""
    sim = sim or Similarity()
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    classes = scratch.store(shingle_classes(rows), "classes")
    _, root = _components(rows.select("text"), classes, scratch, sim)
    scratch.drop("ranked")
    least = (classes.where("node is not null").groupBy("node")
             .agg(F.min("doc_id").alias("least"))
             .join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = scratch.store(least, "least")
    label = scratch.store(
        least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root")
        .select("node", "component_id"), "label")
    return (classes.join(label, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


__all__ = ["Similarity", "components", "ngram_jaccard_join", "ngram_link_counts", "ngram_links",
           "ranked_sets", "shingle_classes"]
