"""Histogram gradient boosting for squared error, as a small numpy kernel.

The kernel runs inside Spark tasks (whole items in
``mapInArrow``, or one pooled training set), and its split finder is shared with the
distributed trainer, which builds the same histograms with Spark aggregations.

Semantics follow the usual histogram-boosting recipe:

* features are binned by thresholds at the midpoints of consecutive distinct
  values (at most ``max_bins`` bins; quantile midpoints beyond that); NaN gets
  its own bin;
* the first prediction is the mean target; gradients (prediction - target) are
  stored as float32, hessians are 1;
* a node's value is ``-G / (H + l2)``; a split's gain is the loss of the node
  minus the losses of both children, the loss of a node being ``G * value``
  (the root starts at value 0); splits need ``min_samples_leaf`` rows per side;
* nodes are split best-gain-first until ``max_depth`` / ``max_leaf_nodes``;
  leaf values are multiplied by the learning rate at the end of each tree;
* a root with fewer than ``2 * min_samples_leaf`` rows is a leaf of value 0,
  so a series too short to split keeps the mean prediction exactly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

G_DTYPE = np.float32
ALMOST_INF = 1e300
EPS = 1e-15
MIN_HESSIAN_TO_SPLIT = 1e-3


# ------------------------------------------------------------------ binning
def bin_thresholds(col: np.ndarray, max_bins: int = 255) -> np.ndarray:
    col = np.asarray(col, dtype=np.float64)
    col = np.sort(col[~np.isnan(col)])
    distinct = np.unique(col)
    if len(distinct) <= max_bins:
        mid = distinct[:-1] + distinct[1:]
        mid *= 0.5
    else:
        # the midpoint of the two values around rank i (n - 1) / max_bins, in whole numbers
        rank = np.arange(1, max_bins, dtype=np.int64) * (len(col) - 1)
        mid = (col[rank // max_bins] + col[-(-rank // max_bins)]) * 0.5
    return np.clip(mid, None, ALMOST_INF)


def map_bins(X: np.ndarray, thresholds: list[np.ndarray], missing_bin: int) -> np.ndarray:
    """Bin index = number of thresholds strictly below the value; NaN -> missing bin."""
    X = np.asarray(X, dtype=np.float64)
    out = np.empty(X.shape, dtype=np.int32)
    for j, thr in enumerate(thresholds):
        col = X[:, j]
        b = np.searchsorted(thr, col, side="left")
        b[np.isnan(col)] = missing_bin
        out[:, j] = b
    return out


def split_threshold(thresholds: list[np.ndarray], feature: int, bin_idx: int) -> float:
    """Raw-value threshold of a split at ``bin_idx``; a split after the last
    non-missing bin separates only NaN (all values go left): +inf."""
    thr = thresholds[feature]
    return float(np.inf) if bin_idx >= len(thr) else float(thr[bin_idx])


# --------------------------------------------------------------- split finder
@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    g_left: float
    h_left: float
    n_left: int


def _node_value(g, h, l2):
    return -g / (h + l2 + EPS)


def find_split(hist_g: np.ndarray, hist_n: np.ndarray, g_node: float, h_node: float,
               n_node: int, value_node: float, n_bins_non_missing: np.ndarray,
               has_missing: np.ndarray, min_samples_leaf: int, l2: float) -> Split | None:
    """Best split of one node from its (features x bins) gradient / count histograms.

    Bins are scanned left to right (missing values to the right) for all
    features at once; features with missing values are also scanned right to
    left (missing values to the left). Within a feature the first best bin
    wins, a right-to-left candidate only if strictly better, and across
    features the first feature with the largest gain.
    """
    p, nbins = hist_g.shape
    loss_node = g_node * value_node
    nb = np.asarray(n_bins_non_missing, dtype=np.int64)
    miss = np.asarray(has_missing, dtype=bool)
    # left to right, all features: prefix sums along the bins
    gl = np.cumsum(hist_g, axis=1)
    nl = np.cumsum(hist_n, axis=1)
    hl = nl.astype(np.float64)
    nr, hr, gr = n_node - nl, h_node - hl, g_node - gl
    end = nb - 1 + miss
    ok = ((np.arange(nbins)[None, :] < end[:, None])
          & (nl >= min_samples_leaf) & (nr >= min_samples_leaf)
          & (hl >= MIN_HESSIAN_TO_SPLIT) & (hr >= MIN_HESSIAN_TO_SPLIT))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = loss_node - gl * _node_value(gl, hl, l2) - gr * _node_value(gr, hr, l2)
    gain = np.where(ok & (gain > 0), gain, -np.inf)
    fbin = np.argmax(gain, axis=1)
    rows = np.arange(p)
    fgain = gain[rows, fbin]
    cand = [None] * p
    for j in np.flatnonzero(fgain > -1.0):
        b = int(fbin[j])
        cand[j] = Split(float(fgain[j]), int(j), b, False, float(gl[j, b]), float(hl[j, b]),
                        int(nl[j, b]))
    # right to left for features with missing values: bins nb-1 .. 1 go right
    for j in np.flatnonzero(miss & (nb >= 2)):
        k = int(nb[j])
        idx = np.arange(k - 2, -1, -1)
        grr = np.cumsum(hist_g[j, idx + 1])
        nrr = np.cumsum(hist_n[j, idx + 1])
        hrr = nrr.astype(np.float64)
        nll, hll, gll = n_node - nrr, h_node - hrr, g_node - grr
        okr = ((nll >= min_samples_leaf) & (nrr >= min_samples_leaf)
               & (hll >= MIN_HESSIAN_TO_SPLIT) & (hrr >= MIN_HESSIAN_TO_SPLIT))
        if not okr.any():
            continue
        gr_ = loss_node - gll * _node_value(gll, hll, l2) - grr * _node_value(grr, hrr, l2)
        gr_ = np.where(okr & (gr_ > 0), gr_, -np.inf)
        t = int(np.argmax(gr_))
        best_j = cand[j].gain if cand[j] is not None else -1.0
        if gr_[t] > best_j:
            cand[j] = Split(float(gr_[t]), int(j), int(idx[t]), True, float(gll[t]), float(hll[t]),
                            int(nll[t]))
    best: Split | None = None
    for c in cand:
        if c is not None and c.gain > (best.gain if best is not None else -1.0):
            best = c
    return best


# ----------------------------------------------------------------- the model
@dataclass
class Model:
    """Trees flattened into parallel node arrays (node ids index these arrays)."""
    baseline: float
    n_trees: int
    tree: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))
    missing_left: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))

    def roots(self) -> np.ndarray:
        if len(self.tree) == 0:
            return np.zeros(0, np.int64)
        starts = np.flatnonzero(np.r_[True, self.tree[1:] != self.tree[:-1]])
        return starts

    def to_row(self, key) -> dict:
        return dict(model_key=key, baseline=float(self.baseline), n_trees=int(self.n_trees),
                    tree=self.tree.tolist(), feature=self.feature.tolist(),
                    threshold=self.threshold.tolist(), missing_left=self.missing_left.tolist(),
                    left=self.left.tolist(), right=self.right.tolist(), value=self.value.tolist())

    @staticmethod
    def from_row(r) -> "Model":
        def arr(v, dt):
            return np.asarray([] if v is None else list(v), dtype=dt)
        return Model(float(r["baseline"]), int(r["n_trees"]), arr(r["tree"], np.int32),
                     arr(r["feature"], np.int32), arr(r["threshold"], np.float64),
                     arr(r["missing_left"], bool), arr(r["left"], np.int32),
                     arr(r["right"], np.int32), arr(r["value"], np.float64))


def predict(model: Model, X: np.ndarray) -> np.ndarray:
    """Raw prediction: baseline plus the leaf value of every tree, in tree order."""
    X = np.asarray(X, dtype=np.float64)
    out = np.full(X.shape[0], model.baseline, dtype=np.float64)
    if len(model.tree) == 0 or X.shape[0] == 0:
        return out
    rows = np.arange(X.shape[0])
    for root in model.roots():
        node = np.full(X.shape[0], root, dtype=np.int64)
        while True:
            f = model.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            x = X[rows[inner], f[inner]]
            n_in = node[inner]
            go_left = np.where(np.isnan(x), model.missing_left[n_in], x <= model.threshold[n_in])
            node[inner] = np.where(go_left, model.left[n_in], model.right[n_in])
        out += model.value[node]
    return out


# ------------------------------------------------------------------ training
class _Node:
    __slots__ = ("idx", "g", "h", "n", "value", "depth", "split", "nid")

    def __init__(self, idx, g, h, n, value, depth):
        self.idx, self.g, self.h, self.n, self.value, self.depth = idx, g, h, n, value, depth
        self.split = None
        self.nid = -1


def _histograms(Xb: np.ndarray, g: np.ndarray, idx: np.ndarray, n_bins: int):
    p = Xb.shape[1]
    sub = Xb[idx] + (np.arange(p, dtype=np.int64) * n_bins)[None, :]
    flat = sub.ravel()
    gw = np.repeat(g[idx].astype(np.float64), p)
    hg = np.bincount(flat, weights=gw, minlength=p * n_bins).reshape(p, n_bins)
    hn = np.bincount(flat, minlength=p * n_bins).reshape(p, n_bins)
    return hg, hn


def _grow_tree(Xb, g, thresholds, nb_non_missing, has_missing, max_bins, *, max_depth,
               learning_rate, min_samples_leaf, l2_regularization, max_leaf_nodes, **_):
    """Grow one tree best-first; returns (node list, per-row leaf value)."""
    n = Xb.shape[0]
    n_bins = max_bins + 1
    nodes: list[_Node] = []
    root = _Node(np.arange(n), float(np.sum(g, dtype=np.float64)), float(n), n, 0.0, 0)
    nodes.append(root)
    leaves: list[_Node] = []
    heap: list = []
    counter = 0

    def push(node):
        nonlocal counter
        hg, hn = _histograms(Xb, g, node.idx, n_bins)
        s = find_split(hg, hn, node.g, node.h, node.n, node.value, nb_non_missing, has_missing,
                       min_samples_leaf, l2_regularization)
        if s is None or s.gain <= 0:
            leaves.append(node)
        else:
            node.split = s
            heapq.heappush(heap, (-s.gain, counter, node))
            counter += 1

    if root.n < 2 * min_samples_leaf or root.h < MIN_HESSIAN_TO_SPLIT:
        leaves.append(root)
    else:
        push(root)
    children: dict[int, tuple[_Node, _Node]] = {}
    while heap:
        _, _, node = heapq.heappop(heap)
        s = node.split
        col = Xb[node.idx, s.feature]
        miss = col == max_bins
        go_left = np.where(miss, s.missing_left, col <= s.bin)
        li, ri = node.idx[go_left], node.idx[~go_left]
        depth = node.depth + 1
        lnode = _Node(li, s.g_left, s.h_left, len(li),
                      _node_value(s.g_left, s.h_left, l2_regularization), depth)
        g_r, h_r = node.g - s.g_left, node.h - s.h_left
        rnode = _Node(ri, g_r, h_r, len(ri), _node_value(g_r, h_r, l2_regularization), depth)
        if not has_missing[s.feature]:
            s.missing_left = lnode.n > rnode.n
        nodes += [lnode, rnode]
        children[id(node)] = (lnode, rnode)
        n_leaf = len(leaves) + len(heap) + 2
        if max_leaf_nodes is not None and n_leaf == max_leaf_nodes:
            leaves += [lnode, rnode]
            while heap:
                leaves.append(heapq.heappop(heap)[2])
                leaves[-1].split = None
            break
        if max_depth is not None and depth == max_depth:
            leaves += [lnode, rnode]
            continue
        for ch in (lnode, rnode):
            if ch.n < 2 * min_samples_leaf:
                leaves.append(ch)
            else:
                push(ch)
    leaf_ids = {id(x) for x in leaves}
    row_value = np.zeros(n, dtype=np.float64)
    for lf in leaves:
        lf.value = learning_rate * lf.value
        row_value[lf.idx] = lf.value
    # number the nodes in creation order; unsplit nodes are leaves
    for i, nd in enumerate(nodes):
        nd.nid = i
    flat = []
    for nd in nodes:
        if id(nd) in leaf_ids or id(nd) not in children:
            flat.append((-1, 0.0, False, -1, -1, nd.value))
        else:
            lch, rch = children[id(nd)]
            s = nd.split
            flat.append((s.feature, split_threshold(thresholds, s.feature, s.bin),
                         bool(s.missing_left), lch.nid, rch.nid, 0.0))
    return flat, row_value


def validation_split(n: int, seed: int, fraction: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(train, validation) row indices: a permutation drawn from ``seed``; the
    first ``ceil(fraction * n)`` rows of it validate, the rest train."""
    n_val = int(np.ceil(fraction * n))
    perm = np.random.RandomState(seed).permutation(n)
    return perm[n_val:], perm[:n_val]


def derived_seed(random_state: int) -> int:
    """The seed used for the validation split and the binning subsample."""
    return int(np.random.RandomState(random_state).randint(np.iinfo(np.uint32).max, dtype="u8"))


def should_stop(scores: list[float], n_iter_no_change: int, tol: float) -> bool:
    """Stop when none of the last ``n_iter_no_change`` scores beats the score
    just before them by more than ``tol`` (scores: higher is better)."""
    ref_pos = n_iter_no_change + 1
    if len(scores) < ref_pos:
        return False
    ref = scores[-ref_pos] + tol
    return not any(sc > ref for sc in scores[-n_iter_no_change:])


def _half_squared(y: np.ndarray, raw: np.ndarray) -> float:
    return float(np.mean(0.5 * (raw - y) ** 2))


def fit(X: np.ndarray, y: np.ndarray, *, max_depth=None, learning_rate=0.1, max_iter=100,
        min_samples_leaf=20, l2_regularization=0.0, max_leaf_nodes=31, max_bins=255,
        early_stopping="auto", validation_fraction=0.1, n_iter_no_change=10, tol=1e-7,
        random_state=42, subsample_rows=200_000) -> Model:
    """Fit a boosted regressor on a (rows x features) float matrix.

    ``early_stopping="auto"`` turns on above 10,000 rows: a validation part
    (``validation_fraction``) is held out and boosting stops once the
    validation loss has not improved by ``tol`` for ``n_iter_no_change`` rounds.
    Bin thresholds come from at most ``subsample_rows`` training rows.
    """
    X = np.asarray(X, dtype=np.float64)
    y = np.asarray(y, dtype=np.float64)
    n_all = X.shape[0]
    if n_all == 0:
        raise ValueError("no training rows")
    seed = derived_seed(random_state)
    do_es = (n_all > 10_000) if early_stopping == "auto" else bool(early_stopping)
    X_val = y_val = None
    if do_es:
        tr, va = validation_split(n_all, seed, validation_fraction)
        X, y, X_val, y_val = X[tr], y[tr], X[va], y[va]
    n = X.shape[0]
    baseline = float(np.mean(y))
    params = dict(max_depth=max_depth, learning_rate=learning_rate,
                  min_samples_leaf=min_samples_leaf, l2_regularization=l2_regularization,
                  max_leaf_nodes=max_leaf_nodes)
    if n < 2 * min_samples_leaf:
        return Model(baseline, max_iter)  # every tree is a single leaf of value 0
    Xs = X
    if n > subsample_rows:
        Xs = X[np.random.RandomState(seed).choice(n, subsample_rows, replace=False)]
    thresholds = [bin_thresholds(Xs[:, j], max_bins) for j in range(X.shape[1])]
    Xb = map_bins(X, thresholds, max_bins)
    nb_non_missing = np.array([len(t) + 1 for t in thresholds])
    has_missing = np.isnan(X).any(axis=0)
    raw = np.full(n, baseline, dtype=np.float64)
    raw_val = None if X_val is None else np.full(len(y_val), baseline, dtype=np.float64)
    scores = [] if raw_val is None else [-_half_squared(y_val, raw_val)]
    cols = {k: [] for k in ("tree", "feature", "threshold", "missing_left", "left", "right", "value")}
    offset = 0
    n_iter = 0
    for it in range(max_iter):
        n_iter = it + 1
        g = (raw - y).astype(G_DTYPE)
        flat, row_value = _grow_tree(Xb, g, thresholds, nb_non_missing, has_missing, max_bins,
                                     **params)
        raw += row_value
        if not (len(flat) == 1 and flat[0][5] == 0.0):  # a lone zero leaf adds nothing
            for (f, thr, ml, lc, rc, v) in flat:
                cols["tree"].append(it)
                cols["feature"].append(f)
                cols["threshold"].append(thr)
                cols["missing_left"].append(ml)
                cols["left"].append(lc + offset if lc >= 0 else -1)
                cols["right"].append(rc + offset if rc >= 0 else -1)
                cols["value"].append(v)
            if raw_val is not None:
                raw_val += predict(_single_tree(flat), X_val)
            offset += len(flat)
        if raw_val is not None:
            scores.append(-_half_squared(y_val, raw_val))
            if should_stop(scores, n_iter_no_change, tol):
                break
    return Model(baseline, n_iter,
                 np.asarray(cols["tree"], np.int32), np.asarray(cols["feature"], np.int32),
                 np.asarray(cols["threshold"], np.float64), np.asarray(cols["missing_left"], bool),
                 np.asarray(cols["left"], np.int32), np.asarray(cols["right"], np.int32),
                 np.asarray(cols["value"], np.float64))


# ------------------------------------------------------- many one-split models
#: series up to this many training rows are fitted together (at most one bin per row)
TOGETHER_ROWS = 255
#: histogram cells of the series that are fitted at once
TOGETHER_CELLS = 1_000_000


def fit_many(X: np.ndarray, y: np.ndarray, train: np.ndarray, starts: np.ndarray, **params
             ) -> tuple[list[Model], list[float | None]]:
    """Models of many series and the mean absolute errors of their other rows.

    A series is the rows from its start to the next one's; ``train`` marks the rows to
    fit. Short series whose trees have one split are fitted together, by the same sums
    in the same order as ``fit``; all others one at a time by ``fit``.
    """
    ends = np.r_[starts[1:], len(y)]
    n_train = np.add.reduceat(train, starts, dtype=np.int64) if len(starts) else starts
    # a midpoint of larger values may not be a number
    huge = (np.add.reduceat(np.abs(X).max(axis=1, initial=0.0, where=~np.isnan(X)) > 1e299,
                            starts, dtype=np.int64) > 0) if len(starts) else starts
    together = ((n_train >= 2 * params["min_samples_leaf"]) & ~huge.astype(bool)
                & (n_train <= min(TOGETHER_ROWS, params["max_bins"])))
    if params["max_depth"] != 1 or (params.get("max_leaf_nodes") or 2) < 2:
        together[:] = False
    models: list[Model | None] = [None] * len(starts)
    for i in np.flatnonzero(~together):
        mine = slice(starts[i], ends[i])
        t = train[mine]
        models[i] = fit(X[mine][t], y[mine][t], early_stopping=False, **params)
    kind = np.ceil(np.log2(np.maximum(n_train, 2))).astype(int)
    for k in np.unique(kind[together]):
        found = np.flatnonzero(together & (kind == k))
        step = max(1, TOGETHER_CELLS // (X.shape[1] * (2 ** k + 1)))
        for lo in range(0, len(found), step):
            part = found[lo:lo + step]
            rows = np.concatenate([np.arange(starts[i], ends[i]) for i in part])
            rows = rows[train[rows]]
            for i, m in zip(part, _fit_stumps(X[rows], y[rows], n_train[part], **params), strict=True):
                models[i] = m
    errors: list[float | None] = [None] * len(starts)
    rest = np.flatnonzero(~train)
    if len(rest):
        which = np.searchsorted(starts, rest, side="right") - 1
        off = np.abs(y[rest] - _predict_many(models, X[rest], which))
        at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        for a, b in zip(at, [*at[1:], len(rest)], strict=True):
            errors[which[a]] = float(np.mean(off[a:b]))
    return models, errors


def _predict_many(models: list[Model], X: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Row i predicted by model ``which[i]`` (rows of a model are consecutive)."""
    out = np.array([m.baseline for m in models])[which]
    grown = np.array([len(m.tree) for m in models])
    stump = grown == 3
    at = np.flatnonzero(stump[which])
    if len(at):
        pick = (lambda f, dt: np.array([f(m) if s else 0 for m, s in zip(models, stump, strict=True)],
                                       dtype=dt)[which[at]])
        x = X[at, pick(lambda m: m.feature[0], np.int64)]
        left = np.where(np.isnan(x), pick(lambda m: m.missing_left[0], bool),
                        x <= pick(lambda m: m.threshold[0], np.float64))
        out[at] += np.where(left, pick(lambda m: m.value[1], np.float64),
                            pick(lambda m: m.value[2], np.float64))
    for i in np.flatnonzero(grown > 3):
        mine = slice(*np.searchsorted(which, [i, i + 1]))
        out[mine] = predict(models[i], X[mine])
    return out


def _fit_stumps(X: np.ndarray, y: np.ndarray, n: np.ndarray, *, learning_rate, max_iter,
                min_samples_leaf, l2_regularization, **_) -> list[Model]:
    """``fit`` with trees of one split for series of ``n`` rows each that lie one after another."""
    m, p = len(n), X.shape[1]
    first = np.cumsum(np.r_[0, n[:-1]])
    item = np.repeat(np.arange(m), n)
    spans = list(zip(first.tolist(), (first + n).tolist(), strict=True))
    miss = np.logical_or.reduceat(np.isnan(X), first, axis=0)
    kinds = np.zeros((m, p), dtype=np.int64)
    bins, cuts = np.empty(X.shape, dtype=np.int64), []
    width = int(n.max()) + 1  # the last bin is of missing values
    for j in range(p):
        order = np.lexsort((X[:, j], item))  # missing values last
        x, who = X[order, j], item[order]
        ok = ~np.isnan(x)
        same = np.r_[False, (who[1:] == who[:-1]) & (x[1:] == x[:-1])]
        new = ok & ~same
        count = np.cumsum(new)
        rank = count - (count[first] - new[first])[who] - 1  # among the series' values
        kinds[:, j] = np.add.reduceat(new, first, dtype=np.int64)
        at = np.flatnonzero(new & (rank > 0))
        mid = np.clip((x[at - 1] + x[at]) * 0.5, None, ALMOST_INF)
        cut = np.full((m, width), np.inf)
        cut[who[at], rank[at] - 1] = mid
        cuts.append(cut)
        # a midpoint that rounds up to the value above it isn't below that value
        rank -= (rank > 0) & (cut[who, rank - 1] >= x)
        bins[order, j] = np.where(ok, rank, width - 1)
    kinds = np.maximum(kinds, 1)
    baseline = np.array([np.mean(y[a:b]) for a, b in spans])
    raw = baseline[item]
    cell = ((item[:, None] * p + np.arange(p)) * width + bins).ravel()
    size = m * p * width
    hist_n = np.bincount(cell, minlength=size).reshape(m, p, width)
    n_left = np.cumsum(hist_n, axis=2)
    h_left = n_left.astype(np.float64)
    h_right = n[:, None, None] - h_left
    legal = ((np.arange(width) < (kinds - 1 + miss)[:, :, None]) & (n_left >= min_samples_leaf)
             & (h_right >= min_samples_leaf) & (h_left >= MIN_HESSIAN_TO_SPLIT)
             & (h_right >= MIN_HESSIAN_TO_SPLIT))
    trees: list[list[tuple]] = [[] for _ in range(m)]
    for it in range(max_iter):
        g = (raw - y).astype(G_DTYPE)
        hist_g = np.bincount(cell, weights=np.repeat(g.astype(np.float64), p),
                             minlength=size).reshape(m, p, width)
        g_all = np.array([np.sum(g[a:b], dtype=np.float64) for a, b in spans])
        g_left = np.cumsum(hist_g, axis=2)
        g_right = g_all[:, None, None] - g_left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ((g_all * 0.0)[:, None, None]
                    - g_left * _node_value(g_left, h_left, l2_regularization)
                    - g_right * _node_value(g_right, h_right, l2_regularization))
            gain = np.where(legal & (gain > 0), gain, -np.inf).reshape(m, -1)
        at = np.argmax(gain, axis=1)  # the first best bin of the first best feature
        rows = np.arange(m)
        live, feature, bin_ = gain[rows, at] > 0, at // width, at % width
        gl, nl = g_left[rows, feature, bin_], n_left[rows, feature, bin_]
        missing_left = nl > n - nl
        for i in np.flatnonzero(miss.any(axis=1)):  # missing values may go either way
            s = find_split(hist_g[i], hist_n[i], g_all[i], float(n[i]), int(n[i]), 0.0, kinds[i],
                           miss[i], min_samples_leaf, l2_regularization)
            live[i] = s is not None and s.gain > 0
            if live[i]:
                feature[i], bin_[i], gl[i], nl[i] = s.feature, s.bin, s.g_left, s.n_left
                missing_left[i] = s.missing_left if miss[i, s.feature] else nl[i] > n[i] - nl[i]
        left = learning_rate * _node_value(gl, nl.astype(np.float64), l2_regularization)
        right = learning_rate * _node_value(g_all - gl, (n - nl).astype(np.float64),
                                            l2_regularization)
        found = np.stack(cuts)[feature, rows, bin_]
        threshold = np.where(bin_ >= kinds[rows, feature] - 1, np.inf, found)
        for i in np.flatnonzero(live):
            trees[i].append((it, int(feature[i]), float(threshold[i]), bool(missing_left[i]),
                             float(left[i]), float(right[i])))
        if it + 1 < max_iter:
            b = bins[np.arange(len(y)), feature[item]]
            to_left = np.where(b == width - 1, missing_left[item], b <= bin_[item])
            raw = raw + np.where(live[item], np.where(to_left, left[item], right[item]), 0.0)
    return [_stump_model(float(b), max_iter, t) for b, t in zip(baseline, trees, strict=True)]


def _stump_model(baseline: float, n_trees: int, trees: list[tuple]) -> Model:
    if not trees:
        return Model(baseline, n_trees)
    it, feature, threshold, missing_left, left, right = zip(*trees)
    k = np.arange(0, 3 * len(it), 3)
    leaf, zero, no = [-1] * len(it), [0.0] * len(it), [False] * len(it)

    def nodes(*columns, dtype):
        return np.array(columns, dtype=dtype).T.ravel()
    return Model(baseline, n_trees, nodes(it, it, it, dtype=np.int32),
                 nodes(feature, leaf, leaf, dtype=np.int32),
                 nodes(threshold, zero, zero, dtype=np.float64),
                 nodes(missing_left, no, no, dtype=bool), nodes(k + 1, leaf, leaf, dtype=np.int32),
                 nodes(k + 2, leaf, leaf, dtype=np.int32), nodes(zero, left, right, dtype=np.float64))


def _single_tree(flat) -> Model:
    """One grown tree as a zero-baseline model (for incremental validation scores)."""
    f, thr, ml, lc, rc, v = (np.asarray(c) for c in zip(*flat))
    return Model(0.0, 1, np.zeros(len(flat), np.int32), f.astype(np.int32), thr.astype(np.float64),
                 ml.astype(bool), lc.astype(np.int32), rc.astype(np.int32), v.astype(np.float64))
