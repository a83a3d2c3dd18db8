"""The prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Levels are peeled from the deepest at which
two different conversations meet: conversations that end there merge with the nodes that
survive from below, each surviving node loses its last turn, and what is left is grouped
again, so that one aggregation a level both discovers the nodes and sums up their subtrees.
Equal conversations are merged first, and what a conversation has below the deepest meeting
is a chain of its own, which its row alone gives: rounds grow with the depth that different
conversations share, not with their length.

Turns are known by digests: a text moves once, into its place within its conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import Scratch
from hearth.llm.mixing import word_count

KEY = 16  # bytes of a prefix's digest
IDS = 4096  # a packed run of conversation numbers holds at most so many
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, turn_key, words)``: turns in order of ``turn``, null first, ties by role and
    text; null roles and texts are empty. ``pos`` counts from 1."""
    w = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("conv", F.row_number().over(w).cast("long").alias("pos"), key.alias("turn_key"),
                       word_count(F.col("text")).cast("long").alias("words"))


def head_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its block's first one: 0 to 3."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 4, F.lit(0))


def rebuild(rows: DataFrame, block: int = 20) -> DataFrame:
    """:func:`turns` of rebuilt conversations, with a row of null ``turn_key`` at ``pos`` 0 for each.

    A conversation ``c`` takes its first turns (:func:`head_turns`) from conversation
    ``c - c % block`` (as far as that has them, none if it is absent), then follow its own
    turns after as many. A conversation of null number keeps its own turns.
    """
    convs = rows.groupBy("conv").agg(F.lit(1).alias("one")).select("conv", head_turns(F.col("conv")).alias("h"))
    heads = rows.where((F.col("conv") % block == 0) & (F.col("pos") <= 3)).select(
        F.col("conv").alias("base"), "pos", "turn_key", "words")
    taken = convs.join(heads, (F.col("conv") - F.col("conv") % block == F.col("base")) & (F.col("pos") <= F.col("h")))
    own = rows.where(F.col("pos") > head_turns(F.col("conv")))
    none = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_key"),
                        F.lit(0).cast("long").alias("words"))
    cols = ["conv", "pos", "turn_key", "words"]
    return own.select(cols).unionByName(taken.select(cols)).unionByName(none)


PATHS = "conv long, depth long, last binary, path binary, words array<long>"


def paths(rows: DataFrame) -> DataFrame:
    """``PATHS``: of each conversation the digests of all its prefixes, one after the other,
    the digest of the last, and the words of its turns."""
    lists = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("t"))
    lists = lists.select("conv", F.filter("t", lambda x: x["turn_key"].isNotNull()).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for keys in b.column(1).to_pylist():
                last, path = b"", []
                for k in keys:
                    last = hashlib.md5(last + k).digest()
                    path.append(last)
                out.append((len(path), last, b"".join(path)))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()),
                 b.column(2)], names=["conv", "depth", "last", "path", "words"])

    return lists.select("conv", "t.turn_key", "t.words").mapInArrow(run, PATHS)


SEQUENCES = "depth long, last binary, path binary, words array<long>, conv_id long, n_convs long, ends_sha256 string"


def sequences(whole: DataFrame) -> DataFrame:
    """``SEQUENCES``: one row for all conversations with the same turns, with the digest of
    their numbers in rising order.

    Numbers are packed in runs of at most ``IDS``; a task reads a sequence's runs in order
    and keeps the state of the digest, so copies of any number take little memory.
    """
    run = F.floor(F.col("conv") / IDS).cast("long")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("conv"))), lambda x: F.coalesce(x["conv"].cast("string"), F.lit("")))
    packed = whole.groupBy("last", run.alias("run")).agg(
        F.first("depth").alias("depth"), F.first("path").alias("path"), F.first("words").alias("words"),
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.array_join(texts, ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or r["last"] != now["last"]:
                    if now:
                        out.append(now | {"ends_sha256": sha.hexdigest()})
                    now, sha = r, hashlib.sha256(r.pop("ids").encode())
                    continue
                sha.update(b"," + r["ids"].encode())
                now["n_convs"] += r["n_convs"]
                now["conv_id"] = r["conv_id"] if now["conv_id"] is None else now["conv_id"]
            yield _rows(out)
        yield _rows([now | {"ends_sha256": sha.hexdigest()}] if now else [])

    def _rows(rows: list[dict]) -> pa.RecordBatch:
        kinds = [("depth", pa.int64()), ("last", pa.binary()), ("path", pa.binary()), ("words", pa.list_(pa.int64())),
                 ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds], names=[c for c, _ in kinds])

    sorted_ = packed.repartition("last").sortWithinPartitions("last", "run")
    return sorted_.mapInArrow(digest, SEQUENCES)


def meeting_depth(seqs: DataFrame) -> int:
    """The deepest level at which different sequences share a node."""
    prefix = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.substring("path", (KEY * (i - 1) + 1).cast("int"), F.lit(KEY)))
    keys = seqs.where("depth > 0").select(F.posexplode(prefix).alias("at", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("at")).where("n > 1")
    return int(shared.agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("d")).head()["d"])


def _chains(seqs: DataFrame, meet: int) -> DataFrame:
    """``NODES`` deeper than ``meet``: each is on one sequence only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, at = r["depth"] - meet, range(meet, r["depth"])
                keys = [r["path"][KEY * i:KEY * (i + 1)] for i in at]
                up = [r["path"][KEY * (i - 1):KEY * i] if i else b"" for i in at]
                below = np.cumsum(np.array(r["words"][meet:], np.int64)[::-1])[::-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(up, pa.binary()), pa.array([i + 1 for i in at], pa.int64()),
                     pa.array([r["conv_id"]] * n, pa.int64()), pa.array([r["n_convs"]] * n, pa.int64()),
                     pa.array([1] * (n - 1) + [0], pa.int64()), pa.array([1] * n, pa.int64()),
                     pa.array((r["n_convs"] - 1) * below, pa.int64()), pa.array([NO_ENDS] * (n - 1) + [r["ends_sha256"]], pa.string())],
                    names=["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

    return seqs.where(F.col("depth") > meet).mapInArrow(run, NODES)


def _prefix(depth: int) -> Column:
    return F.substring("path", KEY * (depth - 1) + 1, KEY) if depth else F.lit(b"")


def peel(seqs: DataFrame, scratch: Scratch) -> DataFrame:
    """``NODES`` of the trie of :func:`sequences`, level by level from the deepest meeting."""
    meet = meeting_depth(seqs)
    zero = F.lit(0).cast("long")
    # below the deepest meeting every sequence is a child of its own
    words = F.aggregate(F.slice("words", meet + 1, F.greatest(F.size("words") - meet, F.lit(0))), zero, lambda a, x: a + x)
    open_ = seqs.where(F.col("depth") > meet).select(
        F.substring("path", 1, KEY * meet).alias("path"), F.slice("words", 1, meet).alias("words"), "conv_id", "n_convs",
        F.lit(1).cast("long").alias("child"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * words).alias("saved"), F.lit(None).cast("string").alias("ends"))
    levels = [_chains(seqs, meet)]
    for depth in range(meet, -1, -1):
        ended = seqs.where(F.col("depth") == depth).select(
            "path", "words", "conv_id", "n_convs", zero.alias("child"), zero.alias("leaves"), zero.alias("saved"),
            F.col("ends_sha256").alias("ends"))
        grouped = open_.unionByName(ended).groupBy(_prefix(depth).alias("key")).agg(
            F.first("path").alias("path"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
        last = F.element_at("words", depth) if depth else zero
        level = scratch.save(grouped.select(
            "key", _prefix(max(depth - 1, 0)).alias("parent"), F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs",
            "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "path", "words"), f"level{depth}")
        levels.append(level.drop("path", "words"))
        open_ = level.select(  # the last turn goes
            F.substring("path", 1, KEY * max(depth - 1, 0)).alias("path"), F.slice("words", 1, max(depth - 1, 0)).alias("words"),
            "conv_id", "n_convs", F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"),
            F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return nodes


def prefix_trie(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the prefix trie of conversations ``rows (conv, pos, turn_key, words)``, as
    :func:`rebuild` gives them: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    An empty table has no nodes. Turnless conversations end at the root. Equal turns are equal
    whatever their conversation; a null conversation number counts as a member, is left out
    of minima and is empty text in digests, first of all.
    """
    seqs = scratch.save(sequences(scratch.save(paths(rows), "paths")), "sequences")
    nodes = scratch.save(peel(seqs, scratch), "nodes")
    up = nodes.select(F.col("key").alias("k"), (F.col("depth") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(up, (F.col("parent") == F.col("k")) & (F.col("depth") == F.col("d")), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
