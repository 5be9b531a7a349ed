"""Shared steps of the similarity joins: stored tables, links and components.

``link`` turns postings (key, node, ...) into exactly the verified links that
are needed to know every component, without writing all pairs of a group:

1. each posting is paired with its key's central member (fewest unshared
   elements), the pairs are verified and joined into components;
2. keys whose members still lie in several components pair members across
   components only, again under the filters, and verify those.

Two members of one component need no further pair for this, so a group of near
copies costs a number of rows linear in its size, and no link between components
is lost. The links inside a component are not all among these; ``ngram_join``
verifies them where they are asked for.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgecast.session import ensure_workers_can_import, scratch_path

#: largest table of ids that is broadcast; above it the ids are joined by a shuffle
BROADCAST_BYTES = 16 << 20
ARROW_ROWS = "1000"
SCAN_ROWS = "512"
#: shuffled bytes that a task of a stored table reads and sorts
TASK_BYTES = "16m"
#: bytes of a row group that a writing task buffers
ROW_GROUP_BYTES = 16 << 20
#: edges (two numbers each) whose components one task finds
TASK_EDGES = 500_000


class Scratch:
    """Intermediate tables of one job in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        ensure_workers_can_import(spark)
        # rows hold whole texts: small Arrow and scan batches bound the memory on both sides
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)
        self.spark = spark
        self.base = f"{scratch_path(spark, job)}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str, narrow: bool = False,
              fused: bool = True) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, survives lost executors.

        ``narrow``: for tables far smaller than those they come from, an eighth of the
        shuffle partitions write them, so that they aren't many tiny files.
        ``fused``: false for joins with long conditions under an aggregate. As one method of
        whole-stage code they cost the JVM's compiler up to 1.5 GB while it optimises them.
        """
        path = f"{self.base}/{name}"
        if narrow:
            df = df.coalesce(max(1, shuffle_partitions(self.spark) // 8))
        size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        code = "spark.sql.codegen.wholeStage"
        before = {k: self.spark.conf.get(k) for k in (size, code)}
        if _bytes(before[size]) > _bytes(TASK_BYTES):
            self.spark.conf.set(size, TASK_BYTES)
        if not fused:
            self.spark.conf.set(code, "false")
        try:
            df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        # plain reads: a vectored one of a local file system takes threads and buffers of its own
        return (self.spark.read.schema(df.schema)
                .option("parquet.hadoop.vectored.io.enabled", "false").parquet(path))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and the shuffle files of ended jobs."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)
        # Spark deletes shuffle files when the driver collects what refers to them; a driver
        # with memory to spare wouldn't do so before the disk is full
        gc.collect()
        jvm.System.gc()


def _bytes(size: str) -> int:
    """Bytes of a setting such as 64MB, 16m or 1048576b."""
    number = size.lower().rstrip("b")
    return (int(number[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[number[-1]]
            if number[-1:].isalpha() else int(number))


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "inner",
             limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a wide table with a stored table of unique ids (and numbers, or lists of them).

    The ids are broadcast when their rows and list entries make at most ``limit`` bytes, so
    the wide table isn't shuffled; beyond that both sides are. Same rows either way.
    """
    lists = [f.name for f in ids.schema.fields if f.dataType.typeName() == "array"]
    row = F.lit(16 * len(ids.columns))
    for c in lists:
        row = row + 16 * F.greatest(F.size(c), F.lit(0))
    size = (ids.agg(F.sum(row)).first()[0] or 0) if limit else 1
    return df.join(F.broadcast(ids) if size <= limit else ids.hint("merge"), on, how)


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by one edge per node to the least node it reaches there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for lo in range(0, len(nodes), 1 << 16):
        part = nodes[lo:lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([parent[x] for x in part], pa.int64())],
            names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least node.

    Edges are contracted inside each partition first; then alternating
    large-star and small-star rounds run on the remaining forest until every
    edge points at the least node. Each round's tables are stored, so the joins
    read plain scans, which adaptive execution can split at a hot root. The
    rounds end as soon as the edges are stars. A forest of ``TASK_EDGES`` edges at
    most is contracted once more, in one task, and needs no rounds.
    """
    forest = (edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
              .where("a <> b").mapInArrow(_local_forest, "node bigint, root bigint"))
    e = scratch.store(forest.distinct(), f"{name}-0", narrow=True)
    if e.count() <= TASK_EDGES:
        return scratch.store(e.coalesce(1).mapInArrow(_local_forest, "node bigint, root bigint"),
                             f"{name}-all")
    step = 0
    while not _stars(e):
        step += 1
        both = e.union(e.select("root", "node"))
        least = scratch.store(both.groupBy("node").agg(
            F.least(F.min("root"), F.col("node")).alias("least")), f"{name}-{step}-m")
        large = (both.join(least, "node").where("root > node")
                 .select(F.col("root").alias("node"), F.col("least").alias("root")).distinct())
        large = scratch.store(large, f"{name}-{step}-l")
        least2 = scratch.store(large.groupBy("node").agg(F.min("root").alias("least")),
                               f"{name}-{step}-n")
        small = (large.join(least2, "node").where("root <> least")
                 .select(F.col("root").alias("node"), F.col("least").alias("root"))
                 .union(least2).distinct())
        small = scratch.store(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", *(f"{name}-{step}-{x}" for x in "mln"))
        e = small
    return e


def _stars(e: DataFrame) -> bool:
    """Whether every node of the stored edges has one root, which is no node itself and less.

    Then each root is the least node of its component, and the rounds are done.
    """
    roles = (e.select("node", F.lit(1).alias("out"), F.lit(0).alias("into"))
             .union(e.select("root", F.lit(0), F.lit(1)).distinct())
             .groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")))
    return roles.where("out > 1 or (out = 1 and into = 1)").isEmpty()


class Similarity:
    """Jaccard threshold num/den as exact integer conditions on two rows l and r."""

    def __init__(self, num: int = 4, den: int = 5) -> None:
        self.num, self.den = num, den

    def prefix_length(self, n: Column) -> Column:
        """Elements of a set of n of which one at least is shared with every partner."""
        need = F.floor((n * self.num + self.den - 1) / self.den)
        return (n - need + 1).cast("int")

    def overlap(self, n1: Column, n2: Column) -> Column:
        """Least intersection of linked sets of these sizes."""
        whole = self.num + self.den
        return F.floor((self.num * (n1 + n2) + whole - 1) / whole)

    def possible(self, left: str, right: str, cols: list[str]) -> Column:
        """Length, positional and suffix filters, none of which loses a link."""
        def both(c: str) -> tuple[Column, Column]:
            return F.col(f"{left}.{c}"), F.col(f"{right}.{c}")

        n1, n2 = both("n")
        u1, u2 = both("u")  # elements in no other set
        # x shared elements are enough if x * whole >= least: whole numbers, no division
        whole, least = F.lit(self.num + self.den), self.num * (n1 + n2)
        ok = F.least(n1 - u1, n2 - u2) * whole >= least
        if "pos" in cols:  # position of the shared key, rarest element first
            p1, p2 = both("pos")
            ok = ok & ((F.least(p1 - u1, p2 - u2) + F.least(n1 - p1, n2 - p2)) * whole >= least)
        sketch = [c for c in cols if c.startswith("s_")]
        if sketch:
            apart = u1 + u2
            for c in sketch:
                x, y = both(c)
                apart = apart + F.bit_count(x.bitwiseXOR(y))
            ok = ok & (F.shiftright(n1 + n2 - apart, 1) * whole >= least)
        return ok

    def verified(self, n1: Column, n2: Column, shared: Column) -> Column:
        return self.den * shared >= self.num * (n1 + n2 - shared)


def link(postings: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame],
         sim: Similarity, scratch: Scratch, name: str = "link",
         pivots: int = 0) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and the components (node, root) they make.

    ``postings`` (stored): key, node, n (set size), u (elements in no other
    set), optionally pos. ``sketches``: node and parity bitmaps s_*.
    ``sets_of(nodes)`` gives (node, n, elements) for a table of unique nodes.
    Links are complete up to components: a pair of sets that share a key and
    pass the threshold is a link or lies inside one component already.
    """
    cols = postings.columns
    marks = [c for c in sketches.columns if c != "node"]
    rest = [c for c in cols if c != "key"]
    members = postings.groupBy("key").agg(
        F.count("*").alias("members"), F.min(F.struct("u", *(c for c in rest if c != "u"))).alias("c"),
        *(F.min_by(F.struct("u", *(c for c in rest if c != "u")), F.xxhash64("node", F.lit(k)))
          .alias(f"c{k}") for k in range(pivots))).where("members > 1")
    if pivots:
        members = members.select("key", F.explode(F.array_distinct(F.array(
            "c", *(f"c{k}" for k in range(pivots))))).alias("c"))
    centre = scratch.store(members.select("key", "c.*"), f"{name}-centre", narrow=True)
    near = (postings.alias("l").join(centre.alias("r"), F.col("l.key") == F.col("r.key"))
            .where((F.col("l.node") != F.col("r.node")) & sim.possible("l", "r", cols)))
    ends = [F.struct(f"{side}.node", f"{side}.n", f"{side}.u") for side in "lr"]
    pairs = near.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
    for side in "ab":
        pairs = (pairs.withColumn("node", F.col(f"{side}.node")).join(sketches, "node")
                 .withColumn(side, F.struct(f"{side}.*", *marks)).select("a", "b"))
    pairs = pairs.where(sim.possible("a", "b", ["n", "u", *marks])).select("a.node", "b.node")
    links1 = _verify(pairs.toDF("a", "b"), sets_of, sim, scratch, f"{name}-1")
    root1 = components(links1, scratch, f"{name}-c1")

    # keys whose members lie in several components
    at = scratch.store(
        postings.join(centre.select("key"), "key", "left_semi")
        .join(root1, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        .select(*cols, "comp"), f"{name}-at")
    main = (at.groupBy("key", "comp").agg(F.count("*").alias("members"))
            .groupBy("key").agg(F.max_by("comp", "members").alias("main"),
                                F.count("*").alias("comps")).where("comps > 1"))
    main = scratch.store(main.select("key", "main"), f"{name}-main", narrow=True)
    open_ = scratch.store(at.join(main, "key").join(sketches, "node"), f"{name}-open", narrow=True)
    # every pair across components has a member outside the key's main component
    left = open_.where("comp <> main").alias("l")
    cross = left.join(open_.alias("r"), (F.col("l.key") == F.col("r.key"))
                      & (F.col("l.comp") != F.col("r.comp"))
                      & ((F.col("r.comp") == F.col("r.main"))
                         | (F.col("l.node") < F.col("r.node")))
                      & sim.possible("l", "r", [*cols, *marks]))
    links2 = _verify(cross.select(F.least("l.node", "r.node").alias("a"),
                                  F.greatest("l.node", "r.node").alias("b")).distinct(),
                     sets_of, sim, scratch, f"{name}-2")
    links = links1.union(links2)
    root = root1 if links2.isEmpty() else components(
        root1.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links2),
        scratch, f"{name}-c2")
    scratch.drop(f"{name}-centre", f"{name}-at", f"{name}-main", f"{name}-open")
    return links, root


def _verify(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], sim: Similarity,
            scratch: Scratch, name: str) -> DataFrame:
    """Each candidate pair (a, b) once against both whole sets."""
    pairs = scratch.store(pairs, f"{name}-pairs", narrow=True, fused=False)
    nodes = scratch.store(pairs.select(F.col("a").alias("node"))
                          .union(pairs.select("b")).distinct(), f"{name}-nodes", narrow=True)
    sets = scratch.store(sets_of(nodes).select("node", "n", "elements"), f"{name}-sets")
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"),
                      F.col("elements").alias("ea"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"),
                      F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    links = scratch.store(pairs.join(one, "a").join(two, "b")
                          .where(sim.verified(F.col("na"), F.col("nb"), shared))
                          .select("a", "b"), f"{name}-links", narrow=True)
    scratch.drop(f"{name}-pairs", f"{name}-nodes", f"{name}-sets")
    return links


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def longs(values: np.ndarray) -> list[pa.Array]:
    """Columns of an int64 matrix as Arrow arrays."""
    return [pa.array(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1])]
