"""A training corpus from ``documents``: quality rules, SimHash near-duplicates, repeated
passages, mixing to target weights, best-fit packing."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearth.llm import mixing, packing, quality, simhash, suffixes  # noqa: E402
from hearth.llm.common import Scratch, table  # noqa: E402


_opened: list[Scratch] = []  # folders of the stage that runs


def _scratch(spark: SparkSession, name: str) -> Scratch:
    _opened.append(Scratch(spark, name))
    return _opened[-1]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are."""
    judged = quality.judge(docs, _scratch(spark, "stage-quality"), carry=True)
    return judged.where("kept").select("row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as it is."""
    return simhash.one_of_each(docs, _scratch(spark, "stage-simhash"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document of smaller id also has; n_chars
    follows the text."""
    cut = suffixes.remove_repeats(docs, _scratch(spark, "stage-suffix"), rewrite=True)
    size = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), _scratch(spark, "stage-mix"), key=["doc_id", "text"])
    mixed = mixed.where("_epochs > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_epochs").cast("int"))))
    return mixed.select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: document, piece, place in its sequence, checksum of its ids."""
    return packing.pack(docs, _scratch(spark, "stage-pack"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_documents),
]

# Fingerprints, robust estimates and tokenisation are out of SQL's reach; the tests hold
# the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each is written and read again, and what it
    wrote on the way goes when its output stands."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        _opened.clear()
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        for used in _opened:
            used.drop("")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
