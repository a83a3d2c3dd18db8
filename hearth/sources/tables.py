"""Readers. Every reader returns a lazy DataFrame; Catalyst prunes columns and
pushes filters into the Parquet scan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.sources.schemas import SCHEMAS, check_schema


def table_path(base_dir: str, name: str) -> str:
    """``<dir>/<name>.parquet`` when that exists, else ``<dir>/<name>`` (a folder
    of part files, as written by :func:`write_table`)."""
    single = os.path.join(base_dir, f"{name}.parquet")
    if "://" in base_dir or os.path.exists(single):
        return single
    return os.path.join(base_dir, name)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer input splits than the
    cluster's default parallelism (e.g. one large single-row-group file), so
    CPU-heavy per-row work (tokenising, matrix products) uses every core. With
    many splits, as at scale, this is a no-op and adds no shuffle."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave as is
        return df
    return df.repartition(target)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", options: dict | None = None,
               balance: bool = False) -> DataFrame:
    """Read a table and check it against a declared schema.

    ``schema`` may be a ``StructType`` or the name of one in ``SCHEMAS``. The file's
    own schema (Parquet footer, no data read) is compared first; the declared
    schema is then used for the scan so that no inference pass runs on CSV/JSON.
    """
    if isinstance(schema, str):
        schema = SCHEMAS[schema]
    reader = spark.read.options(**(options or {}))
    if schema is None:
        return reader.format(fmt).load(path)
    if fmt in ("parquet", "orc"):
        found = reader.format(fmt).load(path).schema
        check_schema(found, schema, what=path)
        df = reader.format(fmt).load(path).select(*[f.name for f in schema.fields])
    else:
        df = reader.schema(schema).format(fmt).load(path)
    return spread(df) if balance else df


def read_pair(spark: SparkSession, train_path: str, test_path: str,
              schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Train / validation files with one schema, as one DataFrame with a ``split``
    column (``'train'`` / ``'validation'``). Filtering on ``split`` prunes the
    other file's scan entirely."""
    train = read_table(spark, train_path, schema, fmt).withColumn("split", F.lit("train"))
    test = read_table(spark, test_path, schema, fmt).withColumn("split", F.lit("validation"))
    return train.unionByName(test)


def from_pandas(spark: SparkSession, pdf, schema: T.StructType | str | None = None) -> DataFrame:
    """An in-memory pandas frame as a DataFrame (Arrow transfer)."""
    if isinstance(schema, str):
        schema = SCHEMAS[schema]
    return spark.createDataFrame(pdf, schema=schema)


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Excel workbook scan via the pandas-on-Spark reader.

    Needs the ``openpyxl`` package, which is optional; without it this raises
    ``ImportError`` and the workbook should be converted to Parquet/CSV upstream.
    """
    try:
        import openpyxl  # noqa: F401
    except ImportError as exc:  # pragma: no cover - depends on the image
        raise ImportError("read_excel needs openpyxl; convert the workbook to "
                          "Parquet or CSV and use read_table") from exc
    import pyspark.pandas as ps
    df = ps.read_excel(path).to_spark()
    if schema is not None:
        if isinstance(schema, str):
            schema = SCHEMAS[schema]
        check_schema(df.schema, schema, what=path)
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return df
