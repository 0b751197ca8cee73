"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the plans this library builds: AQE re-plans joins
# from runtime sizes (broadcast vs sort-merge), coalesces small shuffle
# partitions and splits skewed ones; UTC keeps timestamp semantics stable.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files go when the driver no longer refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "grantlens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's scale settings.

    On a cluster pass ``master=None`` and let spark-submit decide; locally the
    shuffle partition count defaults to the core count instead of 200.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is None and master and master.startswith("local"):
        cores = master[master.find("[") + 1:-1] if "[" in master else "1"
        shuffle_partitions = os.cpu_count() if cores == "*" else int(cores)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("GRANTLENS_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only for local runs.

    The directory is the one that ``spark.checkpoint.dir`` names. Where it is
    unset, a local master (tests, one machine) gets a folder that goes with
    the process; a cluster is refused, as a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage (HDFS/S3/ABFS) "
            "so iterative jobs can cut lineage and survive executor loss")
    local_dir = tempfile.mkdtemp(prefix="grantlens-ckpt-")
    atexit.register(shutil.rmtree, local_dir, ignore_errors=True)
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()
