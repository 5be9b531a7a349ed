"""Merkle manifest of a dataset: subtree per source, one root, a proof for every row.

1. Each row's leaf digest is taken in the scan; only digests and keys are shuffled.
2. Leaves are range-partitioned and sorted by (source, id), which numbers them within
   their source without one task per source.
3. Level by level, each run of ``ARITY`` consecutive nodes becomes its parent. The
   nodes left over (one per source) are the leaves of the tree above them.
4. Pointer jumping: every node starts with a pointer to its parent and one segment
   step (the siblings left and right of it). In round k a row whose pointer stands at
   an odd multiple of 2**k of the depth joins the node there and appends its segment,
   so pointers reach multiples of 2**(k+1). Only leaves and nodes at those depths go
   on, and after log2(depth) self-joins every leaf has its whole path to the root.
   At most ``ARITY`` ** (2**k - 1) leaves share a pointer in round k, so no key of
   these joins is hot.

Digests are SHA-256; inner nodes hash the lowercase hex of their children. Defined
cases: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value; null
sources and ids come first; rows with one id are ordered by leaf digest, equal rows in
any order (each has a place and a proof of its own); a null id is never tampered with;
a lone leaf is its source's subroot, a lone subroot the root; an empty table has no
root and gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgecast.llm.graph import Scratch, shuffle_partitions
from forgecast.operators.splits import global_positions

ARITY = 3
#: tree above the sources' subroots
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: (partition, source) places that are broadcast; a row has two numbers and a source name
BROADCAST_BYTES = 32 << 20

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition
_ID = ["tree", "level", "pos"]
_PTR = [f"to_{c}" for c in _ID]
_KID = "struct<pos:bigint,digest:binary,key:bigint,other:binary>"


def framed(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """Binary SHA-256 of the framed columns."""
    return F.unhex(F.sha2(F.concat(*(framed(c) for c in columns)), 256))


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def _height(size: Column) -> Column:
    """Levels above ``size`` nodes: the number of powers of ARITY below ``size``."""
    powers = [ARITY ** k for k in range(40) if ARITY ** k < 1 << 62]
    return reduce(lambda x, y: x + y, ((size > F.lit(p)).cast("int") for p in powers))


def placed_leaves(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, level, pos, size, digest, key, other) of (source, key, digest, other) rows.

    ``tree`` numbers the sources in order, ``pos`` the leaves of each, ``size`` counts them.
    """
    order = [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"),
             F.col("tie")]
    found = scratch.store(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    sorted_ = (found.repartitionByRange(shuffle_partitions(found.sparkSession), *order)
               .sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
               .withColumn("part", F.shiftright("at", _LOCAL_BITS)))
    sorted_ = scratch.store(sorted_.drop("tie"), "sorted")
    # one row per partition and source in it
    parts = scratch.store(sorted_.groupBy("part", "source").agg(
        F.count("*").alias("n"), F.min("at").alias("first")), "parts")
    sources = global_positions(parts.groupBy("source").agg(F.sum("n").alias("size")),
                               [F.col("source").asc_nulls_first()], name="tree")
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy("part")
                            .rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    places = scratch.store(
        parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
        .select(F.col("p.part").alias("p_part"), F.col("p.source").alias("p_source"), "first",
                "ahead", "size", "tree"), "places")
    size = places.agg(F.sum(F.coalesce(F.octet_length("p_source"), F.lit(0)) + 64)).first()[0] or 0
    out = sorted_.join(F.broadcast(places) if size <= BROADCAST_BYTES else places,
                       (F.col("part") == F.col("p_part"))
                       & F.col("source").eqNullSafe(F.col("p_source")))
    return out.select(F.col("tree").cast("bigint"), F.lit(0).alias("level"),
                      (F.col("ahead") + F.col("at") - F.col("first")).alias("pos"),
                      F.col("size").cast("bigint"), "digest", "key", "other")


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of consecutive nodes of trees that have more than one left."""
    return (nodes.where("size > 1")
            .groupBy("tree", "level", F.floor(F.col("pos") / ARITY).alias("up"), "size")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "key", "other")))
                 .cast(f"array<{_KID}>").alias("kids")))


def _parents(runs: DataFrame) -> DataFrame:
    joined = F.concat(*(F.coalesce(_hex(F.get("kids", F.lit(k)).digest), F.lit(""))
                        for k in range(ARITY)))
    return runs.select(
        "tree", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"),
        F.ceil(F.col("size") / ARITY).cast("bigint").alias("size"),
        F.unhex(F.sha2(joined, 256)).alias("digest"), F.lit(None).cast("bigint").alias("key"),
        F.lit(None).cast("binary").alias("other"))


def _tree(nodes: DataFrame, size: int, scratch: Scratch, name: str
          ) -> tuple[list[DataFrame], DataFrame]:
    """Stored runs of every level and the nodes that are left (one per tree)."""
    levels, left = [], nodes.where("size = 1")
    while size > 1:
        levels.append(scratch.store(_runs(nodes), f"{name}-{len(levels)}"))
        nodes = _parents(levels[-1])
        left = left.union(nodes.where("size = 1"))
        size = -(-size // ARITY)
    return levels, left


def _steps(runs: DataFrame, depth: Column) -> DataFrame:
    """One row per node: its id and depth, its pointer to the parent and its one step."""
    def side(there: Column, k: int) -> Column:
        d = F.get("kids", F.lit(k)).digest
        return F.when(there & d.isNotNull(), d).otherwise(F.lit(b""))

    at = F.col("i")
    left = F.concat(*(side(F.lit(k) < at, k) for k in range(ARITY)))
    right = F.concat(*(side(F.lit(k) > at, k) for k in range(ARITY)))
    # the last node of a source's tree is a leaf of the tree above
    last = (F.col("size") <= ARITY) & (F.col("tree") != TOP)
    return (runs.select("tree", "level", "up", "size", "kids",
                        F.posexplode("kids").alias("i", "kid"))
            .select("tree", "level", F.col("kid.pos").alias("pos"), depth.alias("depth"),
                    F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias(_PTR[0]),
                    F.when(last, F.lit(0)).otherwise(F.col("level") + 1).alias(_PTR[1]),
                    F.when(last, F.col("tree")).otherwise(F.col("up")).alias(_PTR[2]),
                    (depth - 1).alias("to_depth"), F.col("kid.key").alias("key"),
                    F.col("kid.digest").alias("digest"), F.col("kid.other").alias("other"),
                    F.array(F.struct(left.alias("left"), right.alias("right"))).alias("path")))


def manifest(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, bytes | None, int]:
    """(key, digest, other, path) of every leaf, the root and the height of the top tree.

    ``leaves``: (source, key, digest, other). ``path`` has one (left, right) step per
    level: the digests before and after the node in its run, ``ARITY - 1`` at most.
    """
    nodes = scratch.store(placed_leaves(leaves, scratch), "nodes")
    scratch.drop("leaves", "sorted", "parts", "places")
    most, trees = nodes.agg(F.max("size"), F.max("tree")).first()
    if most is None:
        return nodes.select("key", "digest", "other", F.lit(None).alias("path")), None, 0
    levels, subroots = _tree(nodes, most, scratch, "level")
    top = scratch.store(subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"),
        F.col("tree").alias("pos"), F.lit(trees + 1).cast("bigint").alias("size"), "digest",
        F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("other")), "top")
    above, root = _tree(top, trees + 1, scratch, "above")
    height, below = len(above), len(levels)

    steps = [_steps(x, _height(F.col("size")) + height) for x in levels]
    steps += [_steps(x, _height(F.col("size"))) for x in above]
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    alone = nodes.where("size = 1").select(
        *_ID, F.lit(height).alias("depth"), F.lit(TOP).cast("bigint").alias(_PTR[0]),
        F.lit(0).alias(_PTR[1]), F.col("tree").alias(_PTR[2]), F.lit(height).alias("to_depth"),
        "key", "digest", "other", none.alias("path"))
    rows = scratch.store(reduce(DataFrame.union, [*steps, alone]), "jump-0")
    leaf = (F.col("level") == 0) & (F.col("tree") != TOP)
    far = 1
    while far <= height + below:
        # pointers go from multiples of ``far`` to multiples of twice that
        moved = F.col("to_depth") % (2 * far) != 0
        to = (rows.where(~leaf & (F.col("depth") % (2 * far) == far))
              .select(*(F.col(c).alias(f"n_{c}") for c in _ID),
                      *(F.col(c).alias(f"n_{c}") for c in (*_PTR, "to_depth", "path"))))
        on = reduce(lambda x, y: x & y, (F.col(p) == F.col(f"n_{c}")
                                         for p, c in zip(_PTR, _ID, strict=True)))
        kept = rows.where(leaf | (F.col("depth") % (2 * far) == 0))
        jumped = kept.where(moved).join(to, on).select(
            *_ID, "depth", *(F.col(f"n_{c}").alias(c) for c in (*_PTR, "to_depth")), "key",
            "digest", "other", F.concat("path", "n_path").alias("path"))
        rows = scratch.store(kept.where(~moved).union(jumped), f"jump-{2 * far}")
        scratch.drop(f"jump-{0 if far == 1 else far}")
        far *= 2
    return rows.where(leaf).select("key", "digest", "other", "path"), root.first().digest, height


def fold(start: Column, path: Column) -> Column:
    """The digest reached from ``start`` by hashing with each step's siblings."""
    return F.aggregate(path, start, lambda acc, s: F.unhex(F.sha2(
        F.concat(_hex(s["left"]), _hex(acc), _hex(s["right"])), 256)))


def tampered(docs: DataFrame) -> Column:
    """Text without its line feeds where 2 divides crc32 of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def merkle_audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    scratch = Scratch(docs.sparkSession, "merkle")
    docs = docs.select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("source").cast("string"), F.col("doc_id").cast("bigint").alias("key"),
                         digest(*fields).alias("digest"),
                         digest(*fields[:-1], tampered(docs)).alias("other"))
    paths, root, height = manifest(leaves, scratch)
    if root is None:
        text = F.lit(None).cast("string")
        return paths.select(F.col("key").alias("doc_id"), text.alias("leaf"),
                            text.alias("subroot"), text.alias("root"), text.alias("proof_sha256"),
                            text.alias("folded_root"), F.lit(None).cast("boolean").alias("verified"))
    own = F.slice("path", F.lit(1), F.size("path") - height)
    steps = F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))
    folded = paths.withColumn("folded", fold(F.col("other"), F.col("path")))
    return folded.select(
        F.col("key").alias("doc_id"), _hex(F.col("digest")).alias("leaf"),
        _hex(fold(F.col("digest"), own)).alias("subroot"), F.lit(root.hex()).alias("root"),
        F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.lit(bytes(root))).alias("verified"))
