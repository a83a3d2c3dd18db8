"""Scoring as a Structured Streaming job.

The scoring operators are per-row column expressions with no state, so the same
plan runs on a streaming DataFrame: new feature files are scored as they land
and appended to a sink. Per-micro-batch metrics go through ``foreachBatch``
into a metrics table (an idempotent append keyed by batch id).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hearth.operators.metrics import evaluate
from hearth.operators.scoring import score_table
from hearth.session import checkpoint_dir


def score_stream(spark: SparkSession, source: str, schema: T.StructType, features: str,
                 weights, bias=None, label: str | None = None, class_names=None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of scored rows read from a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return score_table(reader.parquet(source), features, weights, bias, label, class_names)


def _ckpt(spark: SparkSession, name: str, location: str | None) -> str:
    return location or os.path.join(checkpoint_dir(spark), "streams", name)


def start_scoring(scored: DataFrame, sink: str, name: str = "scoring",
                  checkpoint_location: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Append scored rows to a Parquet sink (exactly-once via the checkpoint)."""
    w = scored.writeStream.format("parquet").outputMode("append") \
        .option("path", sink).option("checkpointLocation", _ckpt(scored.sparkSession, name,
                                                                 checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def start_metrics(scored: DataFrame, metrics_path: str, pred: str = "pred",
                  label: str = "label", name: str = "metrics",
                  checkpoint_location: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """One metrics row per micro-batch under ``metrics_path/batch_id=<n>``. Each
    batch overwrites its own folder, so a retried micro-batch is idempotent."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        m = evaluate(batch, pred, label, nll="nll" if "nll" in batch.columns else None)
        m.withColumn("batch_id", F.lit(batch_id).cast("long")) \
            .write.mode("overwrite").parquet(os.path.join(metrics_path, f"batch_id={batch_id}"))

    w = scored.writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", _ckpt(scored.sparkSession, name, checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
