"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "coverlake", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or fetch) a session with the settings the library assumes.

    AQE on (partition coalescing and skew-join splitting), UTC session time
    zone (dates are compared with DuckDB), UI off (no server is opened).
    On a real cluster pass ``master=None`` and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("COVERLAKE_MASTER")
    if master:  # otherwise spark-submit's master (or Spark's local default)
        builder = builder.master(master)
    parts = shuffle_partitions or int(os.environ.get("COVERLAKE_SHUFFLE_PARTITIONS", "8"))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.shuffle.partitions", str(parts))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               # checkpoint files of collected (unreferenced) datasets are deleted
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", os.environ.get("COVERLAKE_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  Only a local master may
    go without it (tests, trials): it gets a scratch folder of its own; on a
    cluster the driver's disk is no place that executors can read."""
    try:
        sc = spark.sparkContext
    except Exception as exc:        # Spark Connect: no SparkContext, the folder must be named
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from exc
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="coverlake-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)      # our own scratch, one per session
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def importable(spark: SparkSession) -> None:
    """Let Python workers on a shared file system import this package; on a
    cluster without one it is shipped with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost
    executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count; falls back to the default
    parallelism when the setting is not a number (e.g. 'auto')."""
    v = spark.conf.get("spark.sql.shuffle.partitions", "200")
    if str(v).isdigit():
        return int(v)
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return 200
