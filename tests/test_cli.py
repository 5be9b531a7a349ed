"""Command line: train from CSV files, then score a request file."""

import json
import os

from fixtures import PRICE_CSV, SHIP_CSV

from forgecast import config as C
from forgecast.__main__ import main


def test_train_then_score(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / f"{C.TABLE_PRICE}.csv").write_text(PRICE_CSV)
    (raw / f"{C.TABLE_SHIP}.csv").write_text(SHIP_CSV)
    models = str(tmp_path / "models")
    assert main(["train", "--data-dir", str(raw), "--source", "csv", "--models-dir", models,
                 "--stage-to", str(tmp_path / "staged")]) == 0
    out = capsys.readouterr().out.strip().splitlines()
    summary = json.loads(out[-1])
    assert summary["dense_items_trained"] == 1 and summary["sparse_rows"] == 12
    assert os.path.isdir(tmp_path / "staged" / C.TABLE_PRICE)
    req = tmp_path / "requests.json"
    req.write_text("\n".join(json.dumps(r) for r in [
        {"request_id": "a", "action": "forecast_dense", "nsn": C.DENSE_DEMO_NSN, "horizon_months": 3},
        {"request_id": "b", "action": "forecast_sparse"},
        {"request_id": "c", "action": "health"},
        {"request_id": "d", "action": "nope"}]))
    assert main(["score", "--requests", str(req), "--models-dir", models, "--data-dir", str(raw),
                 "--source", "csv", "--out", str(tmp_path / "resp")]) == 0
    resp = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "resp")).collect()}
    assert len(resp["a"].forecast) == 3 and resp["a"].last_history_month == "2025-12-01"
    assert resp["b"].gap_days_between_last_observations == 1218
    assert resp["c"].status == "ok" and resp["d"].error == "unknown action nope"
