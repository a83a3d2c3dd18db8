"""Positions in file order: the row's place in its file, files one after the other by path.

Parquet rows carry their place in the file (``_metadata.row_index``), so a position is that
place plus the rows of the files before. Rows are counted per file by one aggregate and the
prefix sums run over the list of files, which the driver holds anyway to plan the scan: no
sort, window or shuffle touches a row. A slice reads only the files that it overlaps.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE, _ROW, _OFFSET, _KEY = "_hearth_file", "_hearth_row", "_hearth_offset", "_hearth_path"
BROADCAST_FILES_MAX_BYTES = 64 * 1024 * 1024  # of paths and offsets; a larger list is joined by shuffle


@dataclass
class FileOrder:
    """The files of a Parquet table in order of path (by code point), and how many rows stand
    before each. Files without rows are left out. The table must not change meanwhile."""

    spark: SparkSession
    path: str
    files: list[str]
    offsets: list[int]
    total: int

    @classmethod
    def build(cls, spark: SparkSession, path: str) -> "FileOrder":
        """One job: a count per file that reads no column."""
        rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
        files, offsets, total = [], [], 0
        for r in sorted(rows, key=lambda r: r["f"].encode()):
            files.append(r["f"])
            offsets.append(total)
            total += r["count"]
        return cls(spark, path, files, offsets, total)

    def _rows(self) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))

    def _offset(self, df: DataFrame, first: int, last: int) -> DataFrame:
        """``df`` with the offset of its file, one of ``files[first:last]``."""
        files, offsets = self.files[first:last], self.offsets[first:last]
        if len(files) <= 1:
            return df.withColumn(_OFFSET, F.lit(offsets[0] if files else 0).cast("long"))
        table = self.spark.createDataFrame(list(zip(files, offsets)), f"{_KEY} string, {_OFFSET} long")
        size = sum(len(f.encode()) + 16 for f in files)
        if size <= BROADCAST_FILES_MAX_BYTES:
            table = F.broadcast(table)
        return df.join(table, F.col(_FILE) == F.col(_KEY)).drop(_KEY)

    def with_position(self, out: str = "pos") -> DataFrame:
        """Every row of the table with its 0-based position in file order."""
        df = self._offset(self._rows(), 0, len(self.files))
        return df.withColumn(out, (F.col(_OFFSET) + F.col(_ROW)).cast("long")).drop(_FILE, _ROW, _OFFSET)

    def slice(self, start: int, stop: int, out: str | None = None) -> DataFrame:
        """Rows at positions ``[start, stop)``; past the end clips. Files outside are not read:
        the range of paths prunes them when the scan is planned."""
        start, stop = max(0, int(start)), min(int(stop), self.total)
        df = self._rows()
        if stop <= start:
            empty = df.drop(_FILE, _ROW).limit(0)
            return empty.withColumn(out, F.lit(0).cast("long")) if out else empty
        first, last = bisect_right(self.offsets, start) - 1, bisect_right(self.offsets, stop - 1)
        f = F.col("_metadata.file_path")
        df = self.spark.read.parquet(self.path).where((f >= self.files[first]) & (f <= self.files[last - 1])).select(
            "*", f.alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
        df = self._offset(df, first, last)
        pos = (F.col(_OFFSET) + F.col(_ROW)).cast("long")
        df = df.where((pos >= start) & (pos < stop))
        return (df.withColumn(out, pos) if out else df).drop(_FILE, _ROW, _OFFSET)

    def row_at(self, position: int) -> DataFrame:
        """The row at ``position``; none past the end."""
        return self.slice(position, position + 1)

    def with_batch(self, size: int, out: str = "batch_id") -> DataFrame:
        """Consecutive mini-batches of ``size`` rows, the last one shorter."""
        return self.with_position(out).withColumn(out, F.floor(F.col(out) / size).cast("long"))

    def split(self, parts: list[tuple[str, int, int]], out: str = "split") -> DataFrame:
        """Rows of disjoint ranges, e.g. ``[('train', 0, 160), ('test', 160, 200)]``, tagged with
        ``out``, in one pass over the files from the first range to the last."""
        spans = sorted((max(0, a), b, name) for name, a, b in parts if b > max(0, a))
        for (_, b, n1), (a, _, n2) in zip(spans, spans[1:]):
            if a < b:
                raise ValueError(f"ranges {n1!r} and {n2!r} overlap")
        if not spans:
            return self.slice(0, 0).withColumn(out, F.lit(None).cast("string"))
        df = self.slice(spans[0][0], spans[-1][1], out="_hearth_pos")
        tag: Column = F.lit(None).cast("string")
        for a, b, name in spans:
            tag = F.when((F.col("_hearth_pos") >= a) & (F.col("_hearth_pos") < b), F.lit(name)).otherwise(tag)
        return df.withColumn(out, tag).where(F.col(out).isNotNull()).drop("_hearth_pos")
