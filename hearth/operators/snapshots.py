"""A chain of keyed snapshots: a base, versioned deltas, any version in one pass.

Loading stage after stage as overlays costs one join a stage. Here every snapshot is written
once, by version and key bucket, and a version is read with one ``max_by`` over the base and
the deltas up to it: one shuffle, partial aggregation, however long the chain. Compaction
folds deltas into a new base for the buckets that they touch and leaves the others' files;
older bases stay, so older versions can still be read.

Layout: ``bases/base_version=V/bucket=B``, ``deltas/version=V/bucket=B``, and ``manifest``, a
small table of the buckets that each of them has; ``schema`` has the columns and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "kind string, version long, bucket int"


@dataclass
class SnapshotChain:
    """Snapshots of ``values`` by ``key`` under ``path`` in ``buckets`` buckets. Every snapshot has
    one row per key (:func:`hearth.operators.keyed.last_write_wins`)."""

    spark: SparkSession
    path: str
    key: str
    values: Sequence[str]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, kind: str, version: int) -> None:
        """One version of one kind. Writing it again replaces it, so a rerun is the same."""
        column = {"bases": "base_version", "deltas": "version"}[kind]
        path = f"{self.path}/{kind}/{column}={int(version)}"
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        held = self.spark.read.schema(df.select("bucket").schema).parquet(path).distinct()
        held.select(F.lit(kind).alias("kind"), F.lit(int(version)).cast("long").alias("version"), "bucket").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/of={kind}-{int(version)}")

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, *self.values, self._bucket().alias("bucket"))

    def start(self, base: DataFrame) -> "SnapshotChain":
        """The base snapshot, version 0; its keys are those of every version."""
        base.select(self.key, *self.values).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        self._write(self._rows(base).withColumn("changed", F.lit(0).cast("long")), "bases", 0)
        return self

    def append(self, updates: DataFrame, version: int) -> "SnapshotChain":
        """The snapshot that is laid over version ``version - 1`` (or the last one before)."""
        if version < 1:
            raise ValueError("updates have versions from 1")
        self._write(self._rows(updates.where(F.col(self.key).isNotNull())), "deltas", version)
        return self

    def _manifest(self) -> dict[str, list[tuple[int, int]]]:
        """``{kind: [(version, bucket)]}``: at most ``buckets`` rows a version."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").select("kind", "version", "bucket").collect()
        out: dict[str, list[tuple[int, int]]] = {"bases": [], "deltas": []}
        for r in rows:
            out[r["kind"]].append((r["version"], r["bucket"]))
        return out

    def _plan(self, version: int) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """Buckets to read by base version, and by delta version, for a version."""
        held = self._manifest()
        base: dict[int, int] = {}
        for v, b in held["bases"]:
            if v <= version:
                base[b] = max(v, base.get(b, 0))
        bases: dict[int, list[int]] = {}
        for b, v in base.items():
            bases.setdefault(v, []).append(b)
        deltas: dict[int, list[int]] = {}
        for v, b in held["deltas"]:
            if b in base and base[b] < v <= version:  # no base rows: no key of this bucket counts
                deltas.setdefault(v, []).append(b)
        return bases, deltas

    @staticmethod
    def _chosen(column: str, wanted: dict[int, list[int]]) -> Column:
        cond = F.lit(False)
        for v, buckets in sorted(wanted.items()):
            cond = cond | ((F.col(column) == v) & F.col("bucket").isin(sorted(buckets)))
        return cond

    def as_of(self, version: int, only: Sequence[int] | None = None) -> DataFrame:
        """``key``, values and ``changed``, the last version that wrote the key (0: the base), as
        the overlays up to ``version`` leave them. A later null replaces a value; keys that the
        base lacks are left out; a null key takes no update."""
        bases, deltas = self._plan(version)
        packed = F.struct(*[F.col(v) for v in self.values]).alias("v")
        rows = self.spark.read.schema(self._schema("bases")).parquet(f"{self.path}/bases") \
            .where(self._chosen("base_version", bases)).select(self.key, "bucket", F.lit(0).cast("long").alias("at"), "changed", packed)
        if deltas:
            found = self.spark.read.schema(self._schema("deltas")).parquet(f"{self.path}/deltas").where(self._chosen("version", deltas))
            rows = rows.unionByName(found.select(self.key, "bucket", F.col("version").alias("at"),
                                                 F.col("version").alias("changed"), packed))
        if only is not None:
            rows = rows.where(F.col("bucket").isin(list(only)))
        last = F.struct("at", F.xxhash64("v"))
        out = rows.groupBy(self.key).agg(F.max_by(F.struct("v", "changed"), last).alias("x"), F.min("at").alias("first"))
        return out.where(F.col("first") == 0).select(self.key, *[F.col(f"x.v.{v}").alias(v) for v in self.values],
                                                     F.col("x.changed").alias("changed"))

    def _schema(self, kind: str) -> T.StructType:
        """Columns of the bases or the deltas, which have the types of the base."""
        named = self.spark.read.parquet(f"{self.path}/schema").schema.fields
        own = {"bases": [T.StructField("changed", T.LongType()), T.StructField("base_version", T.LongType())],
               "deltas": [T.StructField("version", T.LongType())]}[kind]
        return T.StructType([*named, *own, T.StructField("bucket", T.IntegerType())])

    def compact(self, version: int) -> list[int]:
        """Fold the deltas up to ``version`` into a new base for the buckets that they touch, which
        are returned. Buckets without deltas keep their base, and all earlier files stay."""
        _, deltas = self._plan(version)
        touched = sorted({b for buckets in deltas.values() for b in buckets})
        if touched:
            state = self.as_of(version, touched)
            self._write(state.select(self.key, *self.values, "changed", self._bucket().alias("bucket")), "bases", version)
        return touched
