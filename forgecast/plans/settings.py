"""Settings read from the environment variables the modelled application uses.

Everything in the library takes explicit arguments; this module only maps
the familiar variables onto those arguments for drop-in use.
"""

from __future__ import annotations

import os

from .. import config as C


def _env(name: str) -> str | None:
    v = (os.environ.get(name) or "").strip()
    return v or None


def reader_settings() -> dict:
    """``source``, ``path`` and ``database`` for the readers."""
    return {"source": _env("LOGISTICS_DATA_SOURCE") or "auto",
            "path": _env("LOGISTICS_DATA_DIR"),
            "database": _env("LOGISTICS_DATABASE") or C.DEFAULT_DATABASE}


def run_settings() -> dict:
    """Arguments for ``run_training`` / ``log_run``: the experiment label, the
    run name (label, else the tracker's run name), the experiment, and the
    logging disable flag."""
    label = _env("EXPERIMENT_NAME")
    return {"experiment_name": label,
            "run_name": label or _env("MLFLOW_RUN_NAME"),
            "experiment": _env("MLFLOW_EXPERIMENT_NAME") or C.DEFAULT_EXPERIMENT,
            "disabled": _env("MLFLOW_DISABLE"),
            "dense_nsn": _env("DENSE_DEMO_NSN")}
