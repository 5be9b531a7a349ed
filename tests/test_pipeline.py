"""End-to-end on the sample-schema fixture: goldens through the Spark jobs."""

import datetime as dt

import pytest
from conftest import make_price
from fixtures import DENSE_MAE, SPARSE_MAE
from pyspark.sql import functions as F

from forgecast import config as C
from forgecast import schemas as S
from forgecast.operators import features as FE
from forgecast.operators import training as TR
from forgecast.operators.forecast import recursive_forecast
from forgecast.plans import serving as SV
from forgecast.plans import train as TP


def test_sparse_frame_sizes(price, ship):
    frame = FE.sparse_training_frame(price, ship)
    assert frame.count() == 35 + 12  # 36-row dense item -> 35 pairs, 3 sparse items x 4
    assert FE.sparse_filter(frame).count() == 12


def test_pooled_fit_reproduces_golden_mae(price, ship):
    res = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship))
    assert (res.n_rows, res.n_train) == (12, 9)
    assert res.holdout_mae == pytest.approx(SPARSE_MAE, rel=1e-9)


def test_pooled_fit_needs_eight_rows(spark, price, ship):
    small = price.where(F.col("nsn") == C.SPARSE_DEMO_NSN)
    with pytest.raises(ValueError, match="Not enough sparse rows"):
        TP.sparse_pooled_fit(FE.sparse_training_frame(small, ship))


def test_dense_fit_reproduces_golden_mae(price):
    fits = TP.dense_fits(price.where(F.col("nsn") == C.DENSE_DEMO_NSN)).collect()
    assert len(fits) == 1 and fits[0].status == "ok"
    assert (fits[0].n_usable, fits[0].n_train) == (30, 24)
    assert fits[0].holdout_mae == pytest.approx(DENSE_MAE, rel=1e-12)


def test_dense_boosted_path_matches_kernel(spark):
    """An item long enough to split goes through the Arrow kernel path."""
    import numpy as np
    rng = np.random.default_rng(5)
    n = 80
    prices = 20 + np.cumsum(rng.normal(size=n))
    rows = [("B", str(dt.date(2020, 1, 1) + dt.timedelta(days=30 * i)), float(prices[i]), 10 + i,
             1.0 + 0.01 * i, "S1", C.DENSE_CLASS) for i in range(n)]
    fits = TP.dense_fits(make_price(spark, rows)).first()
    assert fits.status == "ok" and len(fits.tree) > 0 and fits.n_train == (n - 6) * 4 // 5


def test_forecast_mixes_tree_and_constant_models_like_a_plain_recursion(spark):
    """Tree models and empty forests (constant means, which skip the packed
    forest) share one Arrow batch; both equal a step-by-step recursion with
    the kernel's predict."""
    import numpy as np

    from forgecast.operators import boosting as B
    rng = np.random.default_rng(11)
    rows = []
    for item, n in (("T", 90), ("C", 20), ("Z", 3)):  # trees / constant mean / too short
        p = 50 + np.cumsum(rng.normal(size=n))
        rows += [(item, str(dt.date(2019, 1, 15) + dt.timedelta(days=31 * i)), float(p[i]),
                  5 + i % 7, 1.0 + 0.002 * i, "S1", C.DENSE_CLASS) for i in range(n)]
    price = make_price(spark, rows)
    models = TR.model_table(TP.dense_fits(price))
    state = FE.last_lag_vector(price).withColumn(
        "horizon", F.when(F.col("nsn") == "C", F.lit(0)).otherwise(F.lit(4)))
    got = {(r.nsn, r.step): r.forecast_price
           for r in recursive_forecast(state, models).collect()}
    assert {k[0] for k in got} == {"T"}  # C asked for 0 steps, Z has no full lag vector
    state2 = FE.last_lag_vector(price).where(F.col("nsn") == "C")
    got_c = {(r.nsn, r.step): r.forecast_price
             for r in recursive_forecast(state2, models, horizon=3).collect()}
    got.update(got_c)
    for m in models.collect():
        model = B.Model.from_row(m.asDict())
        st = FE.last_lag_vector(price).where(F.col("nsn") == m.model_key).first()
        window = list(st.lags)
        steps = 4 if m.model_key == "T" else 3
        assert (len(model.tree) > 0) == (m.model_key == "T")
        for h in range(1, steps + 1):
            month = float((st.last_date.month - 1 + h) % 12 + 1)
            x = np.array([window + [st.last_demand, st.last_market, month]], dtype=np.float64)
            want = float(B.predict(model, x)[0])
            assert got[(m.model_key, h)] == want, (m.model_key, h)
            window = window[1:] + [want]


def test_recursive_forecast_and_month_end_dates(spark, price):
    dense = price.where(F.col("nsn") == C.DENSE_DEMO_NSN)
    models = TR.model_table(TP.dense_fits(dense))
    fc = recursive_forecast(FE.last_lag_vector(dense), models).orderBy("step").collect()
    assert [r.step for r in fc] == [1, 2, 3, 4, 5, 6]
    assert fc[0].reference_month == "2026-01-01" and fc[5].reference_month == "2026-06-01"
    assert len({r.forecast_price for r in fc}) == 1  # constant model
    rows = [("M", f"2023-{m:02d}-28", 1.0, 1, 1.0, "S1", C.DENSE_CLASS) for m in range(1, 13)]
    rows += [("M", "2024-01-31", 1.0, 1, 1.0, "S1", C.DENSE_CLASS)]
    rows += [("M", f"2022-{m:02d}-28", 1.0, 1, 1.0, "S1", C.DENSE_CLASS) for m in range(1, 13)]
    p = make_price(spark, rows)
    out = recursive_forecast(FE.last_lag_vector(p), TR.model_table(TP.dense_fits(p)), horizon=2)
    assert [r.reference_month for r in out.orderBy("step").collect()] == ["2024-02-29", "2024-03-31"]


def _requests(spark, rows):
    return spark.createDataFrame(rows, S.REQUESTS)


def test_request_defaults_and_errors(spark, price, ship):
    models = TR.model_table(TP.dense_fits(price))
    reqs = _requests(spark, [("1", None, None, None), ("2", "forecast_sparse", None, None),
                             ("3", "forecast_dense", "0000", 3), ("4", "bogus", None, None),
                             ("5", "health", None, None), ("6", "forecast_dense", None, 0),
                             ("7", "forecast_sparse", "0000", None)])
    r = {x.request_id: x for x in SV.route_requests(reqs, price, models).collect()}
    assert (r["1"].action, r["1"].nsn, r["1"].horizon_months) == ("forecast_dense", C.DENSE_DEMO_NSN, 6)
    assert r["2"].nsn == C.SPARSE_DEMO_NSN and r["2"].route == "forecast_sparse"
    assert r["3"].error == "No series for NSN 0000"
    assert r["4"].error == "unknown action bogus"
    assert r["5"].route == "health" and r["5"].error is None
    assert r["7"].error == C.ERR_NEED_SPARSE
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship))
    out = {x.request_id: x for x in SV.respond(reqs, price, ship, models, pooled.model).collect()}
    assert out["6"].forecast == [] and out["6"].last_history_month == "2025-12-01"
    assert len(out["1"].forecast) == 6 and out["1"].model == C.MODEL_NAME
    assert out["5"].status == "ok" and out["5"].models_loaded
    s = out["2"]
    assert s.gap_days_between_last_observations == 1218 and s.last_observed_price == 775.62
    assert s.forecast_next_purchase_price == pytest.approx(786.082, abs=5e-4)
    assert out["4"].model is None and out["4"].error == "unknown action bogus"


def test_run_training_writes_all_sinks(spark, price, ship, tmp_path):
    out = str(tmp_path / "models")
    s = TP.run_training(spark, price, ship, out, dense_nsn=C.DENSE_DEMO_NSN,
                        experiment_name="baseline", run_name="baseline")
    assert s["dense_points"] == 36 and s["dense_gbm_mae_holdout"] == pytest.approx(DENSE_MAE)
    assert s["sparse_gbm_mae_holdout"] == pytest.approx(SPARSE_MAE, rel=1e-9)
    meta = spark.read.json(f"{out}/forecasting_metadata").first()
    assert meta.experiment_name == "baseline"
    assert spark.read.parquet(f"{out}/sparse_training_frame").count() == 47
    assert spark.read.parquet(f"{out}/sparse_gbm").count() == 1
    hist = spark.read.parquet(f"{out}/run_history")
    assert {r.key for r in hist.collect()} >= {"dense_nsn", "dense_points", "sparse_gbm_mae_holdout"}
    cmp = TP.compare_runs(hist).first()
    assert cmp.run_name == "baseline"
    with pytest.raises(ValueError, match="No rows for dense NSN"):
        TP.run_training(spark, price, ship, out, dense_nsn="nope")


def test_models_round_trip_and_health(spark, price, ship, tmp_path):
    out = str(tmp_path / "m")
    TP.run_training(spark, price, ship, out, log_runs=False)
    dense, pooled = TP.load_models(spark, out)
    assert dense.count() == 1 and len(pooled.tree) > 0
    h = TP.health_from_dir(spark, out).first()
    assert h.status == "ok" and h.models_loaded
    bad = TP.health_from_dir(spark, str(tmp_path / "missing")).first()
    assert bad.status is None and not bad.models_loaded and bad.error


def test_table_check_lists_database_when_empty(spark):
    from forgecast.sources import health
    spark.sql("CREATE DATABASE IF NOT EXISTS forgecast_empty_db")
    counts, listing = health.check_tables(spark, "forgecast_empty_db")
    assert {r.row_count for r in counts.collect()} == {0} and listing is not None


def test_all_items_restricted_to_one_equals_single_item_run(spark, price):
    everything = {r.nsn: r for r in TP.dense_fits(price).collect()}
    alone = TP.dense_fits(price.where(F.col("nsn") == C.DENSE_DEMO_NSN)).first()
    assert everything[C.DENSE_DEMO_NSN].asDict() == alone.asDict()


def test_arrow_fit_path_equals_kernel_on_same_rows(spark):
    import numpy as np
    from forgecast.operators import boosting as B
    rng = np.random.default_rng(11)
    n = 90
    prices = 50 + np.cumsum(rng.normal(size=n))
    rows = [("K", str(dt.date(2019, 1, 1) + dt.timedelta(days=7 * i)), float(prices[i]), 5 + i % 9,
             1.0 + 0.001 * i, "S1", C.DENSE_CLASS) for i in range(n)]
    p = make_price(spark, rows)
    fit = TP.dense_fits(p).first()
    feats = FE.dense_split(FE.dense_lag_features(p)).orderBy("pos").toPandas()
    X = feats[C.DENSE_FEATURES].to_numpy(np.float64)
    y = feats["target"].to_numpy(np.float64)
    tr = feats["is_train"].to_numpy(bool)
    m = B.fit(X[tr], y[tr], **C.DENSE_PARAMS)
    assert fit.holdout_mae == float(np.mean(np.abs(y[~tr] - B.predict(m, X[~tr]))))
    assert list(fit.value) == m.value.tolist()


def test_items_are_fitted_together_and_whole_however_batches_are_cut(spark, monkeypatch):
    import numpy as np
    from forgecast.operators import boosting as B
    rng = np.random.default_rng(5)
    p = make_price(spark, [
        (f"I{k}", str(dt.date(2020, 1, 1) + dt.timedelta(days=3 * i)), float(rng.integers(1, 40)), i % 7,
         1.0 + (i % 5) / 10, "S1", C.DENSE_CLASS) for k in range(25) for i in range(20 + 3 * k)])
    split = FE.dense_split(FE.dense_lag_features(p))
    rows = split.toPandas().sort_values(["nsn", "pos"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(TR, "FIT_ROWS", 50)
    try:
        # rows that aren't gathered by item yet
        out = TR.fit_dense_per_item(split.repartition(5, "date"), C.STUMP_PARAMS)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        fits = {r.nsn: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(fits) == 25
    for nsn, g in rows.groupby("nsn"):
        X, y = g[C.DENSE_FEATURES].to_numpy(np.float64), g["target"].to_numpy(np.float64)
        t = g["is_train"].to_numpy(bool)
        m = B.fit(X[t], y[t], early_stopping=False, **C.STUMP_PARAMS)
        assert (fits[nsn].n_usable, fits[nsn].value, fits[nsn].threshold) == (
            len(g), m.value.tolist(), m.threshold.tolist())
        assert fits[nsn].holdout_mae == float(np.mean(np.abs(y[~t] - B.predict(m, X[~t]))))


def test_single_model_mode_scores_every_item_with_one_model(spark, price):
    assert TP.busiest_item(price) == C.DENSE_DEMO_NSN
    fc = TP.single_model_forecast(price, C.DENSE_DEMO_NSN).collect()
    assert {r.nsn for r in fc} == {C.DENSE_DEMO_NSN}  # sparse items have 5 rows < 6 lags
    assert len({r.forecast_price for r in fc}) == 1


def test_settings_from_environment(monkeypatch):
    from forgecast.plans import settings
    monkeypatch.setenv("LOGISTICS_DATA_SOURCE", "csv")
    monkeypatch.setenv("EXPERIMENT_NAME", "scenario_b")
    monkeypatch.setenv("MLFLOW_DISABLE", "yes")
    r, s = settings.reader_settings(), settings.run_settings()
    assert r["source"] == "csv" and r["database"] == C.DEFAULT_DATABASE
    assert s["run_name"] == "scenario_b" and s["experiment"] == C.DEFAULT_EXPERIMENT
    assert TP.log_run(None, {}, "/nowhere", disabled=s["disabled"]) is False


def test_oversized_items_use_the_distributed_trainer(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    n = 70
    prices = 30 + np.cumsum(rng.normal(size=n))
    rows = [("H", str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), float(prices[i]), 3 + i % 5,
             1.0 + 0.002 * i, "S1", C.DENSE_CLASS) for i in range(n)]
    rows += [("Z", str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), 1.0 + i, 1, 1.0, "S1",
              C.DENSE_CLASS) for i in range(20)]
    p = make_price(spark, rows)
    assert TR.oversized_items(p, 50) == ["H"]
    params = dict(C.DENSE_PARAMS, max_iter=8)
    normal = {r.nsn: r for r in TP.dense_fits(p, params).collect()}
    routed = {r.nsn: r for r in TP.dense_fits(p, params, max_group_rows=50).collect()}
    assert set(routed) == {"H", "Z"}
    h1, h2 = normal["H"], routed["H"]
    assert len(h1.tree) == len(h2.tree) > 0
    assert h2.holdout_mae == pytest.approx(h1.holdout_mae, rel=1e-9)
    assert routed["Z"].asDict() == normal["Z"].asDict()


def test_stored_serving_state_answers_like_the_history(spark, price, ship):
    """A stored per-item state (what streams use) gives the same responses as
    building it from the history inside the plan."""
    models = TR.model_table(TP.dense_fits(price))
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship)).model
    reqs = _requests(spark, [(str(i), a, n, h) for i, (a, n, h) in enumerate([
        ("forecast_dense", None, 4), ("forecast_sparse", None, None), ("forecast_sparse", "1680-01-444-5555", None),
        ("forecast_dense", "0000", 3), ("health", None, None), ("forecast_dense", C.DENSE_DEMO_NSN, 0),
        (None, None, None), ("bogus", "x", 1)])])
    stored = SV.store_serving_state(SV.serving_state(price, ship, pooled))
    drop = "prediction_timestamp"
    want = sorted(map(str, SV.respond(reqs, price, ship, models, pooled).drop(drop).collect()))
    got = sorted(map(str, SV.respond(reqs, price, ship, models, pooled, state=stored)
                     .drop(drop).collect()))
    assert got == want and len(got) == 8


def test_hot_items_are_answered_like_the_rest(spark, price, ship):
    """Requests of a hot item take the broadcast path; the answers equal the
    plain shuffle plan's, and the hot list is bounded."""
    models = TR.model_table(TP.dense_fits(price))
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship)).model
    rows = [(f"d{i}", "forecast_dense", C.DENSE_DEMO_NSN, 1 + i % 6) for i in range(40)]
    rows += [(f"s{i}", "forecast_sparse", None, None) for i in range(30)]
    rows += [("x1", "forecast_dense", "0000", 2), ("x2", "health", None, None),
             ("x3", "forecast_sparse", "1680-01-444-5555", None), ("x4", "bogus", "q", 1)]
    reqs = _requests(spark, rows)
    assert SV.hot_items(reqs, 25, 5) == [C.DENSE_DEMO_NSN, C.SPARSE_DEMO_NSN]
    assert SV.hot_items(reqs, 25, 1) == [C.DENSE_DEMO_NSN]
    drop = "prediction_timestamp"
    plain = sorted(map(str, SV.respond(reqs, price, ship, models, pooled, hot_rows=None)
                       .drop(drop).collect()))
    for max_hot in (1, 5):
        hot = SV.respond(reqs, price, ship, models, pooled, hot_rows=25, max_hot_items=max_hot)
        assert sorted(map(str, hot.drop(drop).collect())) == plain
    assert len(plain) == len(rows)


def _grown_model(nodes=400):
    """A grown model of many trees on six lags, demand, market and month."""
    import numpy as np

    from forgecast.operators import boosting as B
    rng = np.random.default_rng(21)
    X = rng.normal(size=(600, 9)) * 10 + 30
    return B.fit(X, X[:, 5] + X[:, 6] + rng.normal(size=600), max_depth=6, learning_rate=0.2,
                 max_iter=nodes, min_samples_leaf=5, l2_regularization=0.0, max_leaf_nodes=31)


def test_one_shared_model_answers_any_item(spark, price, ship):
    """``respond`` with one model: every item with six rows is answered, as by its own copy."""
    model = _grown_model(20)
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship)).model
    items = [r.nsn for r in price.groupBy("nsn").count().orderBy("nsn").collect()]
    counts = {r.nsn: r["count"] for r in price.groupBy("nsn").count().collect()}
    reqs = _requests(spark, [(n, "forecast_dense", n, 5) for n in items]
                     + [("none", "forecast_dense", "0000", 2), ("h", "health", None, None)])
    out = {r.request_id: r for r in SV.respond(reqs, price, ship, model, pooled).collect()}
    own = spark.createDataFrame([model.to_row(n) for n in items], S.MODEL_TABLE)
    from forgecast.operators.forecast import recursive_forecast
    want = {}
    for r in recursive_forecast(FE.last_lag_vector(price), own, horizon=5).collect():
        want.setdefault(r.nsn, []).append((r.step, r.forecast_price))
    assert any(c < C.N_LAGS for c in counts.values())
    for n in items:
        if counts[n] < C.N_LAGS:
            assert out[n].error == f"insufficient history for NSN {n}"
        else:
            got = [(s.step, s.forecast_price) for s in out[n].forecast]
            assert got == sorted(want[n]) and len({p for _, p in got}) > 1
    assert out["none"].error == "No series for NSN 0000" and out["h"].status == "ok"


def test_a_shared_model_is_held_once_not_per_row():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from forgecast.operators.forecast import PackedForest, _forecast_batches
    model = _grown_model()
    assert len(model.tree) > 5_000
    pdf = pd.DataFrame({"nsn": [str(i) for i in range(10_000)],
                        "lags": [np.arange(6.0) + 30] * 10_000, "last_demand": 3.0,
                        "last_market": 1.0, "last_date": pd.Timestamp("2024-01-31"), "horizon": 2})
    tracemalloc.start()
    rows = sum(len(x) for x in _forecast_batches(iter([pdf]), 6, PackedForest([model])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20_000 and peak < 60 << 20


def test_health_is_a_plan_and_looks_into_the_models(spark, price, ship, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    models = TR.model_table(TP.dense_fits(price))
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship)).model
    reqs = _requests(spark, [("h", "health", None, None)])
    spark.sparkContext.setJobGroup("health", "built only")
    plans = [SV.health(spark, models), SV.health(spark, models.limit(0)),
             TP.health_from_dir(spark, str(tmp_path))]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("health")) == 0
    assert [r.first().models_loaded for r in plans[:2]] == [True, False]
    assert plans[2].first().status is None and plans[2].first().error
    for m, loaded in ((models, True), (models.limit(0), False)):
        assert SV.respond(reqs, price, ship, m, pooled, hot_rows=None).first().models_loaded is loaded


def test_repeated_request_ids_are_answered_each(spark, price):
    models = TR.model_table(TP.dense_fits(price))
    item, other = (C.DENSE_DEMO_NSN, models.where(F.col("model_key") != C.DENSE_DEMO_NSN)
                   .select("model_key").first())
    rows = [("a", "forecast_dense", item, 2), ("a", "forecast_dense", item, 2),
            ("a", "forecast_dense", item, 5), ("b", "forecast_dense", item, 0)]
    if other:
        rows.append(("a", "forecast_dense", other[0], 3))
    reqs = spark.createDataFrame(rows, "request_id string, action string, nsn string, "
                                       "horizon_months int")
    for in_place in (False, True):
        routed = SV.route_requests(reqs, price, models)
        got = SV.dense_responses(routed, price, models, broadcast_items=in_place).collect()
        assert sorted((r.request_id, r.nsn, len(r.forecast)) for r in got) == sorted(
            (i, n, h) for i, _, n, h in rows)
        for r in got:
            assert [s.step for s in r.forecast] == list(range(1, len(r.forecast) + 1))


def test_pooled_fit_derives_the_pair_frame_once(spark, price, ship):
    frame = FE.sparse_training_frame(price, ship)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    res = TP.sparse_pooled_fit(frame.mapInPandas(count, frame.schema))
    assert res.holdout_mae == pytest.approx(SPARSE_MAE)
    assert seen.value == frame.count()
