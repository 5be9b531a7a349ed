"""Boosted regression forests on tables of any size, one rule for all of them.

``fit_models`` fits one model per key (or one over all rows) with the same steps at
every size:

1. ``cut_points``: exact bin thresholds of every (model, feature). Equal values are
   counted, counts are ranked by a range sort with running sums, and the quantile
   midpoints are looked up by rank; nothing is sampled.
2. Rows are binned once and stored (features, target, prediction so far).
3. Every tree level is one pass, a job over rows that the executors keep: partial sums of gradients per (model, open node,
   feature, bin), added by Spark. All models grow a level at a time in the same pass.
   Gradients are rounded to 50-bit whole numbers, so sums are exact and the trees don't
   depend on the number of partitions or the order of rows.
4. The first pass of a tree adds the tree before to the predictions; every ``REFRESH``
   trees the stored predictions are written anew, so that a lost partition is made from
   ``REFRESH`` trees at most.

Up to ``PART_ROWS`` rows all rows are one partition, and the passes of step 3 run in
its task; above, each pass is a Spark job. Both run ``boost`` on the same sums and give
equal trees.
"""

from __future__ import annotations

import functools
import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_path, ensure_workers_can_import, scratch_path
from . import boosting as B

#: rows that are one partition
PART_ROWS = 50_000
#: trees between two writes of the predictions
REFRESH = 20
#: models that grow together (their open trees are held by the driver)
MODELS_PER_PASS = 64
#: partial histograms of more partitions than this are added by a shuffle
ADD_PARTS = 16
GRADIENT_BITS = 50
HALF_BITS = 25

_MASK = (1 << HALF_BITS) - 1


def _scale(most: float) -> int:
    """Power of two that makes whole numbers of GRADIENT_BITS of values up to ``most``."""
    return GRADIENT_BITS - (int(np.frexp(most)[1]) if most else 0)


def _halves(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.rint(np.ldexp(values, scale)).astype(np.int64)
    return whole >> HALF_BITS, whole & _MASK


def _value(hi: np.ndarray, lo: np.ndarray, scale: int) -> np.ndarray:
    return np.ldexp(np.asarray(hi, np.float64) * (_MASK + 1) + lo, -scale)


# ------------------------------------------------------------------ cut points
def cut_points(rows: DataFrame, p: int, max_bins: int) -> list:
    """(model, f, cuts) rows: exact thresholds of the features x0, x1, ... of each model.

    Midpoints of consecutive values where a feature has ``max_bins`` values at most;
    else, for i = 1 .. max_bins - 1, the midpoint of the two values around rank
    i (n - 1) / max_bins of its n values in order (the value there if that is whole).
    """
    spark = rows.sparkSession
    path = scratch_path(spark, f"values-{uuid.uuid4().hex}")
    values = rows.select("model", F.explode(F.array(*(
        F.struct(F.lit(j).alias("f"), F.col(f"x{j}").alias("v")) for j in range(p)))).alias("s"))
    order = ["model", "f", "v"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (values.select("model", "s.f", "s.v").where("v is not null and not isnan(v)")
     .groupBy(*order).agg(F.count("*").alias("c"))
     .repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    values = spark.read.parquet(path)
    group = ["model", "f"]
    # one row per (model, feature, partition)
    parts_ = values.groupBy(*group, "part").agg(F.sum("c").alias("rows"), F.count("*").alias("kinds"))
    by = Window.partitionBy(*group)
    parts_ = parts_.select(
        *group, "part", F.sum("rows").over(by).alias("n"), F.sum("kinds").over(by).alias("d"),
        F.coalesce(F.sum("rows").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part", *group).orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (values.join(parts_, [*group, "part"])
              .withColumn("end", F.col("ahead") + F.sum("c").over(inside))
              .withColumn("start", F.col("end") - F.col("c")))
    few = (ranked.where(F.col("d") <= max_bins).groupBy(*group)
           .agg(F.sort_array(F.collect_list("v")).alias("vs"))
           .select(*group, F.expr("transform(slice(vs, 2, size(vs)), (x, i) -> (vs[i] + x) * 0.5D)")
                   .alias("cuts")))
    # i with the rank i (n - 1) / max_bins, rounded down and up, among a value's ranks
    b = max_bins
    ranges = [(f"(start * {b} + n - 2) div (n - 1)", f"(end * {b} + n - 2) div (n - 1) - 1"),
              (f"greatest(start - 1, 0) * {b} div (n - 1) + 1", f"(end - 1) * {b} div (n - 1)")]
    down, up = (ranked.where(f"d > {b}")
                .withColumn("first", F.expr(f"greatest(1, {first})"))
                .withColumn("last", F.expr(f"least({b - 1}, {last})"))
                .where("first <= last")
                .select(*group, F.explode(F.sequence("first", "last")).alias("i"), "v")
                for first, last in ranges)
    found = down.union(up)
    many = (found.groupBy(*group, "i").agg((F.min("v") + F.max("v")).alias("two"))
            .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("i", "two"))).alias("s"))
            .select(*group, F.expr("transform(s, x -> x.two * 0.5D)").alias("cuts")))
    out = few.union(many).select(
        *group, F.transform("cuts", lambda x: F.least(x, F.lit(B.ALMOST_INF))).alias("cuts"))
    rows_ = out.collect()  # models of this pass x features x max_bins numbers at most
    drop_path(spark, path)
    return rows_


# ------------------------------------------------------------------- one model
@dataclass
class Growth:
    """A model being fitted: what is fixed, its trees and the tree that is growing."""

    name: str
    baseline: float
    scale: int
    cuts: list[np.ndarray]
    missing: np.ndarray
    trees: list[list[dict]] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    open: list[int] = field(default_factory=list)
    rounds: int = 0
    done: bool = False
    scores: list[float] = field(default_factory=list)

    def bins(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])

    def work(self, since: int) -> dict:
        """What a pass needs: trees from ``since`` on, the growing tree and its open nodes."""
        return {"baseline": self.baseline, "scale": self.scale, "open": self.open,
                "trees": [_tree_arrays(t) for t in self.trees[since:] if len(t) > 1],
                "nodes": _tree_arrays(self.nodes) if self.nodes else None}


def _raw(bins: np.ndarray, raw: np.ndarray, work: dict, missing_bin: int) -> np.ndarray:
    for tree in work["trees"]:
        raw = raw + tree["value"][_route(bins, tree, missing_bin)]
    return raw


def _sums(bins: np.ndarray, y: np.ndarray, raw: np.ndarray, work: dict, max_bins: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves of the gradient sums and row counts per (open node, feature, bin), flat."""
    p, n_bins = bins.shape[1], max_bins + 1
    node = _route(bins, work["nodes"], max_bins)
    slot = np.full(len(work["nodes"]["feature"]), -1)
    slot[work["open"]] = np.arange(len(work["open"]))
    at = slot[node]
    keep = at >= 0
    g = (raw[keep] - y[keep]).astype(B.G_DTYPE).astype(np.float64)
    hi, lo = _halves(g, work["scale"])
    cell = ((at[keep][:, None] * p + np.arange(p)) * n_bins + bins[keep]).ravel()
    size = len(work["open"]) * p * n_bins
    # sums of whole numbers below 2**53 are exact in float64
    return tuple(np.bincount(cell, weights=np.repeat(x, p), minlength=size).astype(np.int64)
                 for x in (hi, lo)) + (np.bincount(cell, minlength=size),)


Histograms = Callable[[dict[int, Growth]], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def boost(models: dict[int, Growth], params: dict, histograms: Histograms,
          after_tree: Callable[[dict[int, Growth]], None] | None = None) -> None:
    """Grow all trees of all models; each call of ``histograms`` is one pass over the rows."""
    max_depth, lr = params["max_depth"], params["learning_rate"]
    for _ in range(params["max_iter"]):
        live = {k: m for k, m in models.items() if not m.done}
        if not live:
            return
        for m in live.values():
            m.nodes, m.open, m.rounds = [_node(None, None, None, 0.0, 0)], [0], m.rounds + 1
        while growing := {k: m for k, m in live.items() if m.open and
                          (max_depth is None or m.nodes[m.open[0]]["depth"] < max_depth)}:
            sums = histograms(growing)
            for k, m in growing.items():
                _split(m, sums.get(k), params)
        for m in live.values():
            m.nodes = _best_first_prune(m.nodes, params.get("max_leaf_nodes"), max_depth,
                                        params["min_samples_leaf"])
            for nd in m.nodes:
                if nd["feature"] < 0:
                    nd["value"] = lr * nd["value"] if nd is not m.nodes[0] else 0.0
            m.trees.append(m.nodes)
            if len(m.nodes) == 1 and after_tree is None:
                m.done, m.rounds = True, params["max_iter"]  # gradients don't change any more
            m.nodes, m.open = [], []
        if after_tree is not None:
            after_tree(live)


def _split(m: Growth, sums: tuple | None, params: dict) -> None:
    """Split the open nodes of a model where that gains, from the sums of one pass."""
    msl, l2, max_depth = params["min_samples_leaf"], params["l2_regularization"], params["max_depth"]
    p = len(m.cuts)
    open_, m.open = m.open, []
    if sums is None:
        return
    hi, lo, n = (x.reshape(len(open_), p, -1) for x in sums)
    for slot, i in enumerate(open_):
        nd, g = m.nodes[i], _value(hi[slot], lo[slot], m.scale)
        if nd["g"] is None:
            nd["g"] = float(_value(hi[slot][0].sum(), lo[slot][0].sum(), m.scale))
            nd["n"] = int(n[slot][0].sum())
            nd["h"] = float(nd["n"])
        if nd["n"] < 2 * msl:
            continue
        s = B.find_split(g, n[slot], nd["g"], nd["h"], nd["n"], nd["value"], m.bins(), m.missing,
                         msl, l2)
        if s is None or s.gain <= 0:
            continue
        gr, hr = nd["g"] - s.g_left, nd["h"] - s.h_left
        left = _node(s.g_left, s.h_left, s.n_left, -s.g_left / (s.h_left + l2 + B.EPS),
                     nd["depth"] + 1)
        right = _node(gr, hr, nd["n"] - s.n_left, -gr / (hr + l2 + B.EPS), nd["depth"] + 1)
        nd.update(feature=s.feature, bin=s.bin, gain=s.gain, left=len(m.nodes),
                  right=len(m.nodes) + 1, missing_left=s.missing_left if m.missing[s.feature]
                  else left["n"] > right["n"])
        m.nodes += [left, right]
        if max_depth is None or left["depth"] < max_depth:
            m.open += [k for k in (nd["left"], nd["right"]) if m.nodes[k]["n"] >= 2 * msl]


# ------------------------------------------------------------------ the trainer
def fit_models(rows: DataFrame, features: list[str], target: str, params: dict,
               key: str | None = None, validation: str | None = None, n_iter_no_change: int = 10,
               tol: float = 1e-7, part_rows: int = PART_ROWS) -> dict[str, B.Model]:
    """One model per value of ``key`` (one model, named "pooled", without it).

    ``validation`` names a boolean column of rows that are held out of the fit; boosting
    of a model then stops once their loss hasn't improved for ``n_iter_no_change`` trees.
    Without it all rows are fitted for all ``max_iter`` trees. Rows need a target.
    """
    names = [None] if key is None else [r[0] for r in rows.select(key).distinct().orderBy(key)
                                        .collect()]
    out: dict[str, B.Model] = {}
    for lo in range(0, len(names), MODELS_PER_PASS):
        part = names[lo:lo + MODELS_PER_PASS]
        one = rows if key is None else rows.where(F.col(key).isin(part))
        out |= _fit_pass(one, features, target, params, key, part, validation, n_iter_no_change,
                         tol, part_rows)
    return out


def _fit_pass(rows: DataFrame, features: list[str], target: str, params: dict, key: str | None,
              names: list, validation: str | None, n_iter_no_change: int, tol: float,
              part_rows: int) -> dict[str, B.Model]:
    spark, p = rows.sparkSession, len(features)
    ensure_workers_can_import(spark)
    max_bins = params.get("max_bins", 255)
    number = F.lit(0) if key is None else F.element_at(
        F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))), F.col(key))
    held = F.lit(False) if validation is None else F.col(validation)
    base = rows.select(number.cast("int").alias("model"), held.alias("val"),
                       F.col(target).cast("double").alias("y"),
                       *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)))
    learn = base.where("not val")
    stats = {r["model"]: r for r in learn.groupBy("model").agg(
        F.count("*").alias("n"), F.max(F.abs("y")).alias("most"),
        *(F.max(F.isnan(f"x{j}") | F.col(f"x{j}").isNull()).alias(f"m{j}") for j in range(p))
    ).collect()}
    if not stats:
        raise ValueError("no training rows")
    # targets and gradients (at most twice the greatest target) as whole numbers
    scales = {k: _scale(2 * r["most"]) for k, r in stats.items()}
    sums = {r["model"]: r for r in learn.select("model", "y").mapInArrow(
        _target_sums(scales), "model int, hi bigint, lo bigint").groupBy("model").agg(
        F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}
    cuts: dict[int, list[np.ndarray]] = {k: [np.zeros(0)] * p for k in stats}
    for r in cut_points(learn, p, max_bins):
        cuts[r["model"]][r["f"]] = np.array(r["cuts"], dtype=np.float64)
    models = {k: Growth(str(names[k]) if key else "pooled",
                        float(Fraction((sums[k]["hi"] << HALF_BITS) + sums[k]["lo"], r["n"])
                              / Fraction(2) ** scales[k]),
                        scales[k], cuts[k], np.array([bool(r[f"m{j}"]) for j in range(p)]))
              for k, r in stats.items()}
    total = sum(r["n"] for r in stats.values())
    parts = max(1, -(-total // part_rows))
    binned = base.mapInArrow(
        _binner({k: (m.cuts, m.baseline) for k, m in models.items()}, max_bins),
        "model int, val boolean, y double, raw double, bins binary")
    if parts == 1 and validation is None:
        grown = binned.coalesce(1).mapInArrow(_in_one_task(models, params, p, max_bins),
                                              "name string, model binary").collect()
        return {r["name"]: _unpack(r["model"]) for r in grown}
    passes = _Passes(binned.coalesce(parts), parts, p, max_bins)
    after = None if validation is None else passes.validate(n_iter_no_change, tol)
    if after is not None:
        after(models)
    boost(models, params, passes.histograms, after)
    passes.drop()
    return {m.name: _trees_to_model(m.trees, m.cuts, m.baseline, m.rounds)
            for m in models.values()}


def _target_sums(scales: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(who):
                hi, lo = _halves(y[who == k], scales[int(k)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([hi.sum()], pa.int64()),
                     pa.array([lo.sum()], pa.int64())], names=["model", "hi", "lo"])
    return run


def _binner(models: dict[int, tuple[list[np.ndarray], float]], max_bins: int):
    """Rows with their bins (two bytes a feature) and the baseline as prediction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who = b.column(0).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64)
                                 for c in b.columns[3:]]).reshape(len(who), -1)
            bins = np.zeros(x.shape, dtype="<u2")
            raw = np.zeros(len(who))
            for k in np.unique(who):
                cuts, baseline = models[int(k)]
                bins[who == k] = B.map_bins(x[who == k], cuts, max_bins)
                raw[who == k] = baseline
            flat = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(2 * x.shape[1]), len(who), [None, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(raw), flat.cast(pa.binary())],
                names=["model", "val", "y", "raw", "bins"])
    return run


def _columns(b: pa.RecordBatch, p: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(b.column(4).to_pylist()), dtype="<u2").reshape(-1, p)
    return (b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False),
            b.column(2).to_numpy(), b.column(3).to_numpy(), bins.astype(np.int64))


def _in_one_task(models: dict[int, Growth], params: dict, p: int, max_bins: int):
    """All passes over the rows of one partition (``PART_ROWS`` at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_columns(b, p) for b in batches if b.num_rows]
        if not rows:
            return
        who, _, y, raw, bins = (np.concatenate(c) for c in zip(*rows, strict=True))
        mine = {k: [bins[who == k], y[who == k], raw[who == k], 0] for k in models}

        def histograms(growing: dict[int, Growth]) -> dict:
            found = {}
            for k, m in growing.items():
                part = mine[k]
                work = m.work(part[3])
                part[2], part[3] = _raw(part[0], part[2], work, max_bins), len(m.trees)
                found[k] = _sums(part[0], part[1], part[2], work, max_bins)
            return found

        boost(models, params, histograms)
        made = [_trees_to_model(m.trees, m.cuts, m.baseline, m.rounds) for m in models.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.name for m in models.values()], pa.string()),
             pa.array([_pack(x) for x in made], pa.binary())], names=["name", "model"])
    return run


def _pack(model: B.Model) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pylist([model.to_row("")])
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> B.Model:
    return B.Model.from_row(pa.ipc.open_stream(data).read_all().to_pylist()[0])


def _add(one: dict, two: dict) -> dict:
    """Sums of two partitions' histograms, model by model."""
    return one | {k: tuple(x + z for x, z in zip(one[k], v, strict=True)) if k in one else v
                  for k, v in two.items()}


class _Passes:
    """Passes over the stored rows as Spark jobs.

    The rows are stored once per refresh. A pass needs no plan of its own: it reads the rows
    of a partition from the executors' storage, as one record of arrays, with the
    predictions of all trees but the last ones; a partition that is lost is read from the
    stored rows again.
    """

    def __init__(self, binned: DataFrame, parts: int, p: int, max_bins: int) -> None:
        self.spark, self.parts, self.p, self.max_bins = binned.sparkSession, parts, p, max_bins
        self.base, self.version, self.since = scratch_path(
            self.spark, f"boosting-{uuid.uuid4().hex}"), 0, 0
        self.kept: list = []
        self.store(binned)

    def store(self, rows: DataFrame) -> None:
        path = f"{self.base}/{self.version}"
        rows.write.parquet(path)
        self.release()
        self.rows = self.spark.read.schema(rows.schema).parquet(path)
        if self.version:
            drop_path(self.spark, f"{self.base}/{self.version - 1}")
        self.version += 1
        p = self.p

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    who, val, y, raw, bins = _columns(b, p)
                    data = pickle.dumps((who[~val], y[~val], raw[~val], bins[~val].astype("<u2")))
                    yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        def joined(records: Iterator) -> Iterator[tuple]:
            found = [pickle.loads(r["data"]) for r in records]
            if found:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

        self.keep(self.rows.mapInArrow(packed, "data binary").rdd.mapPartitions(joined))
        self.upto = self.since

    def keep(self, records) -> None:
        """Later passes read ``records``; those that they are made from stay stored as well."""
        self.kept.append(records.persist(StorageLevel.MEMORY_AND_DISK))
        for old in self.kept[:-2]:
            old.unpersist()
        self.kept = self.kept[-2:]

    def release(self) -> None:
        for old in self.kept:
            old.unpersist()
        self.kept = []

    def drop(self) -> None:
        self.release()
        drop_path(self.spark, self.base)

    def histograms(self, growing: dict[int, Growth]) -> dict:
        most = max(len(m.trees) for m in growing.values())
        if most - self.since >= REFRESH:
            self.refresh(growing, most)
        p, max_bins = self.p, self.max_bins
        if most > self.upto:  # the first pass of a tree: predictions with the trees before
            grown = {k: m.work(self.upto) for k, m in growing.items()}

            def advance(records: Iterator[tuple]) -> Iterator[tuple]:
                for who, y, raw, bins in records:
                    raw = raw.copy()
                    for k, w in grown.items():
                        mine = who == k
                        raw[mine] = _raw(bins[mine].astype(np.int64), raw[mine], w, max_bins)
                    yield who, y, raw, bins

            self.keep(self.kept[-1].mapPartitions(advance))
            self.upto = most
        work = {k: m.work(most) for k, m in growing.items()}

        def run(records: Iterator[tuple]) -> Iterator[dict]:
            for who, y, raw, bins in records:
                mine = {k: who == k for k in work}
                yield {k: _sums(bins[at].astype(np.int64), y[at], raw[at], work[k], max_bins)
                       for k, at in mine.items() if at.any()}

        found = self.kept[-1].mapPartitions(run)
        # bounded: models of the pass x open nodes x features x bins (x ADD_PARTS)
        return (found.treeReduce(_add) if self.parts > ADD_PARTS and not found.isEmpty()
                else functools.reduce(_add, found.collect(), {}))

    def refresh(self, models: dict[int, Growth], upto: int) -> None:
        """Write the predictions with the trees grown so far."""
        work = {k: m.work(self.since) for k, m in models.items()}
        p, max_bins = self.p, self.max_bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                who, _, _, raw, bins = _columns(b, p)
                raw = raw.copy()
                for k in np.unique(who):
                    if int(k) in work:
                        mine = who == k
                        raw[mine] = _raw(bins[mine], raw[mine], work[int(k)], max_bins)
                yield b.set_column(3, "raw", pa.array(raw))

        self.since = upto
        self.store(self.rows.mapInArrow(run, self.rows.schema))

    def validate(self, n_iter_no_change: int, tol: float) -> Callable[[dict[int, Growth]], None]:
        """Stops models whose loss on the held-out rows doesn't improve any more."""
        def after(models: dict[int, Growth]) -> None:
            work = {k: m.work(self.since) for k, m in models.items()}
            p, max_bins = self.p, self.max_bins

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    who, _, y, raw, bins = _columns(b, p)
                    for k in np.unique(who):
                        mine = who == k
                        e = _raw(bins[mine], raw[mine], work[int(k)], max_bins) - y[mine]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k], pa.int32()), pa.array([float(np.sum(0.5 * e * e))]),
                             pa.array([len(e)], pa.int64())], names=["model", "loss", "n"])

            held = self.rows.where(F.col("val") & F.col("model").isin(list(models)))
            for r in held.mapInArrow(run, "model int, loss double, n bigint").groupBy("model").agg(
                    (F.sum("loss") / F.sum("n")).alias("loss")).collect():
                m = models[r["model"]]
                m.scores.append(-r["loss"])
                m.done = B.should_stop(m.scores, n_iter_no_change, tol)
        return after


# ----------------------------------------------------------------------- trees
def _node(g, h, n, value, depth) -> dict:
    """A tree node (a leaf until it is split)."""
    return dict(g=g, h=h, n=n, value=value, depth=depth, feature=-1, bin=-1,
                missing_left=False, left=-1, right=-1)


def _best_first_prune(nodes: list[dict], max_leaf: int | None, max_depth: int | None,
                      msl: int) -> list[dict]:
    """Replay best-first growth on a level-wise grown tree; drop the splits a
    leaf cap would not reach and renumber the remaining nodes."""
    heap, counter, n_leaves, kept = [], 0, 0, set()

    def push(i):
        nonlocal counter, n_leaves
        if nodes[i]["feature"] >= 0:
            heapq.heappush(heap, (-nodes[i]["gain"], counter, i))
            counter += 1
        else:
            n_leaves += 1

    push(0)
    while heap:
        _, _, i = heapq.heappop(heap)
        kept.add(i)
        lch, rch = nodes[i]["left"], nodes[i]["right"]
        if max_leaf is not None and n_leaves + len(heap) + 2 == max_leaf:
            break  # both children and every queued node stay leaves
        if max_depth is not None and nodes[lch]["depth"] == max_depth:
            n_leaves += 2
            continue
        for ch in (lch, rch):
            if nodes[ch]["n"] < 2 * msl:
                n_leaves += 1
            else:
                push(ch)
    # keep the nodes reachable through kept splits, renumbered in creation order
    reach, stack = [], [0]
    while stack:
        i = stack.pop()
        reach.append(i)
        if i in kept:
            stack += [nodes[i]["left"], nodes[i]["right"]]
    new_id = {old: k for k, old in enumerate(sorted(reach))}
    out = []
    for old in sorted(reach):
        nd = dict(nodes[old])
        if old in kept:
            nd["left"], nd["right"] = new_id[nd["left"]], new_id[nd["right"]]
        else:
            nd.update(feature=-1, bin=-1, left=-1, right=-1, missing_left=False)
        out.append(nd)
    return out


def _tree_arrays(nodes) -> dict:
    """Node dicts -> numpy arrays, so rows are routed with vectorised lookups."""
    return {k: np.array([nd[k] for nd in nodes]) for k in
            ("feature", "bin", "missing_left", "left", "right", "value")}


def _route(bins: np.ndarray, tree: dict, missing_bin: int) -> np.ndarray:
    """Node reached by every binned row (walks until a node without a split)."""
    node = np.zeros(bins.shape[0], dtype=np.int64)
    while True:
        feat = tree["feature"][node]
        idx = np.flatnonzero(feat >= 0)
        if not len(idx):
            return node
        nd = node[idx]
        b = bins[idx, feat[idx]]
        go_left = np.where(b == missing_bin, tree["missing_left"][nd], b <= tree["bin"][nd])
        node[idx] = np.where(go_left, tree["left"][nd], tree["right"][nd])


def _trees_to_model(trees, cuts, baseline, n_trees) -> B.Model:
    cols = {k: [] for k in ("tree", "feature", "threshold", "missing_left", "left", "right", "value")}
    off = 0
    for t, nodes in enumerate(trees):
        if len(nodes) == 1:
            continue
        for nd in nodes:
            leaf = nd["feature"] < 0
            cols["tree"].append(t)
            cols["feature"].append(-1 if leaf else nd["feature"])
            cols["threshold"].append(0.0 if leaf else B.split_threshold(cuts, nd["feature"],
                                                                        nd["bin"]))
            cols["missing_left"].append(False if leaf else bool(nd["missing_left"]))
            cols["left"].append(-1 if leaf else nd["left"] + off)
            cols["right"].append(-1 if leaf else nd["right"] + off)
            cols["value"].append(nd["value"] if leaf else 0.0)
        off += len(nodes)
    return B.Model(baseline, n_trees, np.asarray(cols["tree"], np.int32),
                   np.asarray(cols["feature"], np.int32), np.asarray(cols["threshold"], np.float64),
                   np.asarray(cols["missing_left"], bool), np.asarray(cols["left"], np.int32),
                   np.asarray(cols["right"], np.int32), np.asarray(cols["value"], np.float64))
