"""Helpers shared by the operators: written tables, components, hashed ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import checkpoint_dir

# ASCII white space and its complement, as the words of the contracts have it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run under the shared folder named by ``spark.checkpoint.dir``.

    ``save`` cuts lineage: what follows reads the written files, which survive the
    loss of any executor. ``drop`` removes tables that nothing reads any more (a name of no
    characters: the whole folder); the
    tables a returned DataFrame still reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges (a, b)`` over any orderable node type.

    Returns ``(node, root)`` for every node but the roots, where ``root`` is the
    smallest node reachable. Rounds of hooking (each node hooks to its smallest
    smaller neighbour), pointer jumping and contraction: every step is a join or an
    aggregation with map-side combine, and each round shrinks the graph, so hubs
    and long chains need a logarithmic number of rounds.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    e = scratch.save(edges.select(hi, lo).where("hi <> lo").distinct(), f"{tag}-e0")
    rounds: list[DataFrame] = []
    while e.head(1):
        k = len(rounds)
        r = scratch.save(e.groupBy("hi").agg(F.min("lo").alias("lo")), f"{tag}-r{k}-0")
        jump = 0
        while True:
            y = r.select(F.col("hi").alias("mid"), F.col("lo").alias("far"))
            nxt = scratch.save(
                r.join(y, r.lo == y.mid, "left").select(
                    "hi", F.coalesce("far", "lo").alias("lo"), F.col("far").isNotNull().alias("moved")),
                f"{tag}-r{k}-{jump + 1}")
            moved = nxt.where("moved").head(1)
            r, jump = nxt.drop("moved"), jump + 1
            if not moved:
                break
        rounds.append(r)
        x, y = (r.select(F.col("hi").alias(n), F.col("lo").alias(m)) for n, m in (("n1", "m1"), ("n2", "m2")))
        mapped = (e.join(x, e.hi == x.n1, "left").join(y, e.lo == y.n2, "left")
                  .select(F.coalesce("m1", "hi").alias("a"), F.coalesce("m2", "lo").alias("b")))
        e = scratch.save(mapped.where("a <> b").select(hi, lo).distinct(), f"{tag}-e{k + 1}")
    out = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))  # no rows, right types
    for k, r in reversed(list(enumerate(rounds))):
        up = out.select(F.col("node").alias("n"), F.col("root").alias("up"))
        here = r.join(up, r.lo == up.n, "left").select(F.col("hi").alias("node"), F.coalesce("up", "lo").alias("root"))
        out = scratch.save(here.unionByName(out), f"{tag}-m{k}")
    return out


def star_edges(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the graph over ``0..n-1`` whose edges come in blocks:
    at most ``n - 1`` edges keep the components, however many pairs match."""
    lab = np.arange(n)
    for i, j in blocks:
        while True:
            li, lj = lab[i], lab[j]
            if (li == lj).all():
                break
            m = np.minimum(li, lj)
            np.minimum.at(lab, li, m)
            np.minimum.at(lab, lj, m)
            while (lab[lab] != lab).any():
                lab = lab[lab]
    node = np.flatnonzero(lab != np.arange(n))
    return node, lab[node]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 1 << 16) -> Iterator[pa.Table]:
    """Cut sorted Arrow batches into tables that hold whole groups of equal ``keys``:
    several small groups together, a group never split over two tables."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held.append(t)
        size += t.num_rows
        if size < limit:
            continue
        whole = pa.concat_tables(held)
        cut = _last_group(whole, keys)
        if cut:
            yield whole.slice(0, cut)
        held, size = [whole.slice(cut)], whole.num_rows - cut
    if size:
        yield pa.concat_tables(held)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _last_group(t: pa.Table, keys: list[str]) -> int:
    return int(group_starts(t, keys)[-1])


def hashed_bucket(key: Column, count: Column) -> Column:
    """A bucket in ``0 .. ceil(sqrt(count)) - 1`` that grows with ``key`` (a fraction
    in [0, 1)): about as many buckets as rows in a bucket, so neither the rows of one
    bucket nor the list of buckets gathers in one task, even for a group that holds
    a third of all rows."""
    n = F.ceil(F.sqrt(count.cast("double"))).cast("long")
    return F.least(F.floor(key * n).cast("long"), n - 1)
