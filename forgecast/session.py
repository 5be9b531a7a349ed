"""Session helpers: a local session for tests/bench, and checkpoint-dir lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "forgecast") -> SparkSession:
    """Session for tests and the bench. On a cluster use the cluster's session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 ** 2))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_workers_can_import(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a private folder is created only when
    the session has none (local tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (lineage cuts and "
                               "intermediate tables go there)")
        d = tempfile.mkdtemp(prefix="forgecast-ckpt-")  # local runs / tests only
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "forgecast-tables", name)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on whatever file system it lies."""
    fs, jvm_path = _file_system(spark, path)
    fs.delete(jvm_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _file_system(spark, path)
    return fs.exists(jvm_path)


_PKG_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_workers_can_import(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Local mode: prepend the package root to the workers' ``PYTHONPATH``. On a
    cluster the package is shipped the usual way (``--py-files`` / installed
    on the executors) and this is a no-op.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    cur = sc.environment.get("PYTHONPATH", "")
    parts = [p for p in cur.split(os.pathsep) if p]
    if _PKG_ROOT not in parts:
        sc.environment["PYTHONPATH"] = os.pathsep.join([_PKG_ROOT, *parts])


def recommended_cluster_conf(shuffle_bytes: float, cores: int,
                             target_partition_bytes: float = 256 * 1024 ** 2) -> dict[str, str]:
    """Starting configuration for a cluster run, sized from the expected
    largest shuffle (bytes) and the executor cores.

    Shuffle partitions are sized so a partition is about ``target_partition_bytes``
    (and at least 2 waves of tasks); AQE coalesces small ones and splits skewed
    join partitions at run time.
    """
    parts = max(2 * cores, int(shuffle_bytes // target_partition_bytes) + 1)
    mb = int(target_partition_bytes // 1024 ** 2)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key's join partition even where that costs one more
        # exchange (joins chained on the same key, grouped outputs)
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": f"{mb}m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        # model arrays ride along with item rows: cap Arrow batches by bytes too
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 ** 2),
        "spark.sql.session.timeZone": "UTC",
    }
