"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every hearth job relies on. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splitting handles hot keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, total_cores: int, feature_width: int = 768) -> dict[str, str]:
    """Settings sized for a large run (e.g. 100 TB on ~1,000 executors).

    * input splits of 256 MB keep tokenising tasks short and spill-free;
    * shuffle partitions start at ~256 MB of input each (never fewer than 2x the
      cores) and AQE coalesces them to the advisory size after each stage;
    * a shuffle partition over 4x the median and 1 GB is split (skew join);
    * Arrow batches are capped so one batch of ``feature_width`` doubles stays
      near 32 MB inside the Python worker.
    """
    split = 256 * 1024 * 1024
    shuffle = max(2 * total_cores, int(input_bytes // split) + 1)
    batch_rows = max(1024, min(10_000, (32 * 1024 * 1024) // (8 * max(1, feature_width))))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * split),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


def build_session(master: str = "local[*]", app: str = "hearth",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with hearth's defaults.

    On a cluster pass ``master=None`` semantics via spark-submit instead; the
    defaults here are only the settings hearth's plans assume.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder there; hearth only reads it. When it is
    unset and the master is local (tests, laptops) a scratch folder is created
    and registered; on a cluster an unset value is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext, the setting must be given
        sc = None
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running hearth jobs that cut lineage")
    path = tempfile.mkdtemp(prefix="hearth-ckpt-")
    sc.setCheckpointDir(path)
    return path
