"""Command line: ``python -m forgecast {train,score,check-tables} ...``.

* ``train``: stage raw CSVs (if asked), read the procurement tables, fit both
  model kinds and write the models, frame, summary and run log.
* ``score``: answer a request table (Parquet / JSON lines / CSV with
  request_id, action, nsn, horizon_months) with the stored models.
* ``check-tables``: row counts of the three tables in the database.

Defaults come from the familiar environment variables (``plans/settings.py``).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from .session import ensure_checkpoint_dir, ensure_workers_can_import
    spark = SparkSession.builder.appName("forgecast").getOrCreate()
    ensure_checkpoint_dir(spark)
    ensure_workers_can_import(spark)
    return spark


def _read_requests(spark: SparkSession, path: str):
    from . import schemas as S
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema(S.REQUESTS).csv(path)
    if path.endswith(".json") or path.endswith(".jsonl"):
        return spark.read.schema(S.REQUESTS).json(path)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    from . import config as C
    from .plans import settings

    rs, run = settings.reader_settings(), settings.run_settings()
    p = argparse.ArgumentParser(prog="forgecast")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--data-dir", default=rs["path"])
    t.add_argument("--source", default=rs["source"])
    t.add_argument("--database", default=rs["database"])
    t.add_argument("--models-dir", required=True)
    t.add_argument("--dense-nsn", default=run["dense_nsn"])
    t.add_argument("--stage-to", default=None, help="copy raw CSVs to Parquet here first")
    s = sub.add_parser("score")
    s.add_argument("--requests", required=True)
    s.add_argument("--models-dir", required=True)
    s.add_argument("--data-dir", default=rs["path"])
    s.add_argument("--source", default=rs["source"])
    s.add_argument("--database", default=rs["database"])
    s.add_argument("--out", required=True)
    c = sub.add_parser("check-tables")
    c.add_argument("--database", default=rs["database"])
    a = p.parse_args(argv)

    spark = _session()
    from .sources import readers
    if a.cmd == "check-tables":
        from .sources.health import check_tables
        counts, listing = check_tables(spark, a.database)
        for r in counts.collect():
            print(f"  {r.table_name}: {r.row_count} rows")
        if listing is not None:
            listing.show(truncate=False)
        return 0

    price = readers.load_price_history(spark, a.data_dir, a.source, a.database)
    ship = readers.load_supplier_shipping(spark, a.data_dir, a.source, a.database)
    if a.cmd == "train":
        from .plans import train as TP
        if a.stage_to and a.data_dir:
            from .sources.ingest import stage_raw_tables
            print(json.dumps(stage_raw_tables(spark, a.data_dir, a.stage_to)))
        summary = TP.run_training(spark, price, ship, a.models_dir, dense_nsn=a.dense_nsn,
                                  experiment_name=run["experiment_name"], experiment=run.get("experiment"),
                                  run_name=run["run_name"],
                                  log_runs=(run["disabled"] or "").lower() not in C.DISABLE_FLAG_VALUES)
        print(json.dumps(summary, default=str))
        return 0
    if a.cmd == "score":
        from .plans import serving as SV
        from .plans import train as TP
        dense, pooled = TP.load_models(spark, a.models_dir)
        out = SV.respond(_read_requests(spark, a.requests), price, ship, dense, pooled)
        out.write.mode("overwrite").parquet(a.out)
        print(json.dumps({"responses": os.path.abspath(a.out)}))
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
