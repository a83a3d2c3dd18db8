"""Writers: tables, metric history, head weights, reusable feature tables."""

from __future__ import annotations

import os
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import checkpoint_dir
from hearth.sources.schemas import HEAD


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Distributed write; each task writes its own part file."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_metrics(metrics: DataFrame, path: str, run: str | None = None) -> None:
    """Add metric rows (one per run / round) to a history table.

    With ``run`` they go to that run's own folder, which a retry of the run replaces, and
    the name is read back as the column ``run``. Without, rows are appended each time. One
    history keeps to one of the two ways."""
    rows = metrics.withColumn("recorded_at", F.current_timestamp())
    if run is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.drop("run").write.mode("overwrite").parquet(f"{path}/run={quote(run, safe='')}")


def materialise(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back, so
    later jobs reuse it (encode once, score many times) and lineage is cut.
    The folder comes from ``spark.checkpoint.dir``."""
    spark = spark or df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_head(spark: SparkSession, path: str, weights, bias=None) -> None:
    """Persist a classifier head as a table ``(class_id, w, b)``.
    The head is a parameter (classes x width), not data."""
    w = np.asarray(weights, dtype=float)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=float)
    rows = [(int(c), [float(v) for v in w[c]], float(b[c])) for c in range(w.shape[0])]
    spark.createDataFrame(rows, HEAD).coalesce(1).write.mode("overwrite").parquet(path)


def load_head(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Load a head written by :func:`save_head`; returns ``(W, b)``."""
    rows = spark.read.parquet(path).orderBy("class_id").collect()
    w = np.array([r["w"] for r in rows], dtype=float)
    b = np.array([r["b"] for r in rows], dtype=float)
    return w, b
