"""Boosting kernel: golden metrics, scoring consistency, distributed trainer."""

import io

import numpy as np
import pandas as pd
import pytest
from fixtures import DENSE_MAE, PRICE_CSV, SHIP_CSV, SPARSE_MAE

from forgecast import config as C
from forgecast.operators import boosting as B
from forgecast.operators.forecast import PackedForest


def _sparse_xy():
    p = pd.read_csv(io.StringIO(PRICE_CSV), parse_dates=["date"]).sort_values(["nsn", "date"])
    s = pd.read_csv(io.StringIO(SHIP_CSV), parse_dates=["report_month"]).sort_values(
        ["supplier_id", "report_month"])
    rows = []
    for _, g in p[p.data_density_class == C.SPARSE_CLASS].groupby("nsn"):
        g = g.reset_index(drop=True)
        sh = s[s.supplier_id == g.supplier_id.iloc[0]].tail(3)
        for i in range(1, len(g)):
            gap = (g.date[i] - g.date[i - 1]).days
            rows.append([np.log1p(gap), g.unit_price[i - 1], g.market_index[i], g.demand_quantity[i],
                         g.market_index[i] - g.market_index[i - 1], sh.avg_lead_time_days.mean(),
                         sh.expedite_rate.mean(), g.unit_price[i]])
    a = np.array(rows)
    return a[:, :7], a[:, 7]


def _dense_xy():
    p = pd.read_csv(io.StringIO(PRICE_CSV), parse_dates=["date"])
    d = p[p.nsn == C.DENSE_DEMO_NSN].sort_values("date").reset_index(drop=True)
    pr = d.unit_price.to_numpy()
    X = [list(pr[i - 6:i]) + [float(d.demand_quantity[i]), d.market_index[i], float(d.date[i].month)]
         for i in range(6, len(pr))]
    return np.array(X), pr[6:]


def test_sparse_golden_mae_bit_exact():
    X, y = _sparse_xy()
    k = max(1, len(y) * 3 // 4)
    assert (len(y), k) == (12, 9)
    m = B.fit(X[:k], y[:k], **C.SPARSE_PARAMS)
    mae = float(np.mean(np.abs(y[k:] - B.predict(m, X[k:]))))
    assert mae == SPARSE_MAE


def test_dense_golden_mae_is_constant_mean():
    X, y = _dense_xy()
    k = len(y) * 4 // 5
    assert (len(y), k) == (30, 24)
    m = B.fit(X[:k], y[:k], **C.DENSE_PARAMS)
    assert len(m.tree) == 0 and m.baseline == np.mean(y[:k])
    assert float(np.mean(np.abs(y[k:] - B.predict(m, X[k:])))) == DENSE_MAE


def test_packed_forest_matches_single_model_predict():
    rng = np.random.default_rng(0)
    models, Xs = [], []
    for i in range(5):
        X = rng.normal(size=(60 + 10 * i, 4))
        y = X[:, 0] * 3 + np.sin(X[:, 1]) + rng.normal(scale=0.1, size=len(X))
        models.append(B.fit(X, y, max_depth=3, learning_rate=0.1, max_iter=15, min_samples_leaf=5,
                            l2_regularization=0.0, max_leaf_nodes=31))
        Xs.append(rng.normal(size=(1, 4)))
    X = np.vstack(Xs)
    forest = PackedForest(models + [B.Model(1.5, 10)])
    got = forest.predict(np.vstack([X, X[:1]]))
    want = [B.predict(m, x)[0] for m, x in zip(models, Xs)] + [1.5]
    assert np.array_equal(got, np.array(want))


def test_missing_values_get_their_own_bin_and_direction():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 2))
    y = np.where(X[:, 0] > 0, 5.0, -5.0)
    X[:30, 0] = np.nan
    y[:30] = 20.0
    m = B.fit(X, y, max_depth=3, learning_rate=0.5, max_iter=30, min_samples_leaf=5,
              l2_regularization=0.0, max_leaf_nodes=31)
    pred = B.predict(m, np.array([[np.nan, 0.0], [1.0, 0.0], [-1.0, 0.0]]))
    assert pred[0] > 15 and pred[1] > 3 and pred[2] < -3


def test_max_leaf_nodes_caps_tree_size():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(500, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + rng.normal(scale=0.1, size=500)
    m = B.fit(X, y, max_depth=None, learning_rate=0.1, max_iter=3, min_samples_leaf=2,
              l2_regularization=0.0, max_leaf_nodes=4)
    leaves = [(m.tree == t).sum() for t in np.unique(m.tree)]
    assert all(n == 7 for n in leaves)  # 4 leaves + 3 splits


@pytest.mark.parametrize("with_missing", [False, True])
def test_distributed_trainer_equals_local_kernel(spark, with_missing):
    from forgecast.operators.training import fit_distributed
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 3)).round(2)
    y = 2 * X[:, 0] - X[:, 1] ** 2 + rng.normal(scale=0.05, size=120)
    if with_missing:
        X[::7, 2] = np.nan
    params = dict(max_depth=3, learning_rate=0.1, max_iter=4, min_samples_leaf=5,
                  l2_regularization=0.5, max_leaf_nodes=31, max_bins=255)
    local = B.fit(X, y, **params)
    pdf = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    dist = fit_distributed(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c"], "y", params)
    Xt = rng.normal(size=(50, 3))
    np.testing.assert_allclose(B.predict(dist, Xt), B.predict(local, Xt), rtol=1e-9, atol=1e-9)


def test_should_stop_rule():
    assert not B.should_stop([1, 2, 3], 10, 1e-7)
    flat = [0.0] + [1.0] * 11
    assert B.should_stop(flat, 10, 1e-7)
    assert not B.should_stop(flat[:-1] + [1.5], 10, 1e-7)


def test_validation_split_sizes_and_determinism():
    tr, va = B.validation_split(10_001, B.derived_seed(42))
    assert len(va) == 1001 and len(tr) == 9000 and len(set(tr) | set(va)) == 10_001
    tr2, va2 = B.validation_split(10_001, B.derived_seed(42))
    assert np.array_equal(va, va2)


def test_auto_early_stopping_above_ten_thousand_rows():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(12_000, 3))
    y = X[:, 0] + rng.normal(scale=2.0, size=len(X))  # mostly noise: validation loss plateaus
    params = dict(C.SPARSE_PARAMS)
    m = B.fit(X, y, **params)
    assert 11 <= m.n_trees < params["max_iter"]
    small = B.fit(X[:500], y[:500], **params)
    assert small.n_trees == params["max_iter"]  # no early stopping at 500 rows


def test_distributed_trainer_early_stops(spark):
    from forgecast.operators.training import fit_distributed
    rng = np.random.default_rng(6)
    X = rng.normal(size=(400, 2))
    y = 0.1 * X[:, 0] + rng.normal(scale=3.0, size=400)
    pdf = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y, "pos": np.arange(400)})
    params = dict(max_depth=2, learning_rate=0.3, max_iter=25, min_samples_leaf=20,
                  l2_regularization=0.0, max_leaf_nodes=31, max_bins=255)
    m = fit_distributed(spark.createDataFrame(pdf), ["a", "b"], "y", params, order_col="pos",
                        early_stopping=True, n_iter_no_change=3)
    assert m.n_trees < 25


def test_distributed_trainer_respects_a_binding_leaf_cap(spark):
    from forgecast.operators.training import fit_distributed
    rng = np.random.default_rng(8)
    X = rng.normal(size=(300, 3)).round(2)
    y = X[:, 0] * 2 + np.sin(3 * X[:, 1]) + X[:, 2] ** 2 + rng.normal(scale=0.05, size=300)
    params = dict(max_depth=4, learning_rate=0.2, max_iter=3, min_samples_leaf=5,
                  l2_regularization=0.0, max_leaf_nodes=5, max_bins=255)
    local = B.fit(X, y, **params)
    assert all((local.tree == t).sum() == 9 for t in range(3))  # cap binds: 5 leaves
    pdf = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    dist = fit_distributed(spark.createDataFrame(pdf).repartition(2), ["a", "b", "c"], "y", params)
    assert len(dist.tree) == len(local.tree)
    Xt = rng.normal(size=(40, 3))
    np.testing.assert_allclose(B.predict(dist, Xt), B.predict(local, Xt), rtol=1e-9, atol=1e-9)


def test_equal_trees_for_any_partitioning_and_on_both_sides_of_a_partition(spark):
    """Exact sums and cut points: the same model bit by bit, in one task or by Spark jobs."""
    from forgecast.operators.forests import fit_models
    rng = np.random.default_rng(12)
    params = dict(max_depth=3, learning_rate=0.2, max_iter=3, min_samples_leaf=20,
                  l2_regularization=0.5, max_leaf_nodes=31, max_bins=255)
    for n in (9_990, 10_010):
        X = rng.normal(size=(n, 2))
        X[:, 1] = X[:, 1].round(1)
        X[::9, 0] = np.nan
        y = np.where(np.isnan(X[:, 0]), 1.0, X[:, 0]) * 3 - X[:, 1] + rng.normal(size=n)
        df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y}))
        fits = [fit_models(df.repartition(k), ["a", "b"], "y", params, part_rows=r)["pooled"].to_row("")
                for k, r in ((1, 50_000), (3, 50_000), (8, 50_000), (3, 4_000))]
        assert all(f == fits[0] for f in fits[1:])
        kernel = B.fit(X, y, early_stopping=False, **params)
        assert len(kernel.tree) == len(fits[0]["tree"]) and kernel.n_trees == 3
        Xt = rng.normal(size=(200, 2))
        np.testing.assert_allclose(B.predict(B.Model.from_row(fits[0]), Xt), B.predict(kernel, Xt),
                                   rtol=1e-9, atol=1e-9)


def test_no_row_switch_above_two_hundred_thousand_rows(spark):
    """Cut points and trees of 200,001 rows come from all of them, in one task and in five."""
    from forgecast.operators.forests import cut_points, fit_models
    rng = np.random.default_rng(13)
    x = rng.normal(size=200_001)
    y = np.sin(3 * x) + rng.normal(scale=0.1, size=len(x))
    df = spark.createDataFrame(pd.DataFrame({"a": x, "y": y}))
    (cuts,) = cut_points(df.selectExpr("0 AS model", "a AS x0"), 1, 255)
    assert np.array_equal(cuts["cuts"], B.bin_thresholds(x, 255))
    params = dict(max_depth=2, learning_rate=0.3, max_iter=2, min_samples_leaf=20,
                  l2_regularization=0.0, max_leaf_nodes=31, max_bins=255)
    one, five = (fit_models(df, ["a"], "y", params, part_rows=r)["pooled"].to_row("")
                 for r in (10**6, 50_000))
    assert one == five
    kernel = B.fit(x[:, None], y, early_stopping=False, subsample_rows=10**6, **params)
    np.testing.assert_allclose(B.predict(B.Model.from_row(one), x[:500, None]),
                               B.predict(kernel, x[:500, None]), rtol=1e-9)


def test_many_models_grow_together(spark):
    """All keys grow a level at a time: the number of jobs doesn't grow with the models."""
    from forgecast.operators.forests import fit_models
    rng = np.random.default_rng(14)
    params = dict(max_depth=2, learning_rate=0.3, max_iter=2, min_samples_leaf=5,
                  l2_regularization=0.0, max_leaf_nodes=31, max_bins=255)
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for k in (2, 12):
        X, who = rng.normal(size=(k * 60, 2)), np.repeat(np.arange(k), 60)
        y = X[:, 0] * (1 + who) + rng.normal(scale=0.1, size=len(who))
        df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y,
                                                 "nsn": [f"i{w}" for w in who]})).repartition(3)
        spark.sparkContext.setJobGroup(f"grow-{k}", "fit")
        models = fit_models(df, ["a", "b"], "y", params, key="nsn", part_rows=1)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[k] = len(tracker.getJobIdsForGroup(f"grow-{k}"))
        for w in range(k):
            mine = who == w
            want = B.predict(B.fit(X[mine], y[mine], **params), X[mine])
            np.testing.assert_allclose(B.predict(models[f"i{w}"], X[mine]), want, rtol=1e-9)
    assert jobs[12] <= jobs[2] + 2


@pytest.mark.parametrize("missing", [0.0, 0.2])
@pytest.mark.parametrize("depth, rounds", [(1, 1), (1, 5), (3, 3)])
def test_many_series_at_once_equal_one_at_a_time(depth, rounds, missing):
    rng = np.random.default_rng(depth + rounds)
    n = rng.integers(8, 60, 60)
    n[7] = 400  # more rows than bins
    starts = np.cumsum(np.r_[0, n[:-1]])
    X = np.round(rng.normal(size=(n.sum(), 4)), 1)
    X[:, 3] = 1.0
    X[rng.random(X.shape) < missing] = np.nan
    y = rng.normal(size=len(X))
    if missing:
        X[starts[3], 0], y[starts[5]] = np.inf, np.nan
    train = np.arange(len(X)) - np.repeat(starts, n) < np.repeat(n * 4 // 5, n)
    params = dict(max_depth=depth, learning_rate=0.3, max_iter=rounds, min_samples_leaf=4,
                  l2_regularization=0.5, max_leaf_nodes=31, max_bins=255)
    models, errors = B.fit_many(X, y, train, starts, **params)
    for i, (a, k) in enumerate(zip(starts, n, strict=True)):
        x, t, m = X[a:a + k], y[a:a + k], train[a:a + k]
        one = B.fit(x[m], t[m], early_stopping=False, **params)
        assert repr(models[i].to_row(i)) == repr(one.to_row(i))
        assert repr(errors[i]) == repr(float(np.mean(np.abs(t[~m] - B.predict(one, x[~m])))))


def test_a_pass_reads_kept_records_and_no_plan(spark):
    from forgecast.operators import forests as FO
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=400).round(1), "b": rng.normal(size=400), "y": rng.normal(size=400)})
    pdf.loc[::9, "a"] = np.nan
    params = dict(max_depth=2, learning_rate=0.3, max_iter=45, min_samples_leaf=5,
                  l2_regularization=0.1, max_leaf_nodes=31, max_bins=255)
    calls, histograms = [], FO._Passes.histograms

    def without_plan(self, growing):
        refresh = max(len(m.trees) for m in growing.values()) - self.since >= FO.REFRESH
        rows = self.rows
        if not refresh:
            self.rows = None
        out = histograms(self, growing)
        calls.append(refresh)
        if not refresh:
            self.rows = rows
        return out

    FO._Passes.histograms = without_plan
    try:
        many = FO.fit_models(spark.createDataFrame(pdf).repartition(20), ["a", "b"], "y", params,
                             part_rows=20)["pooled"]  # more partitions than are added by the driver
    finally:
        FO._Passes.histograms = histograms
    one = FO.fit_models(spark.createDataFrame(pdf), ["a", "b"], "y", params)["pooled"]
    assert repr(many.to_row(0)) == repr(one.to_row(0))
    assert calls.count(True) == 2 and len(calls) > 80
