"""The training-data pipeline: STAGES in order, each over all that its predecessor kept.

Every stage is one operator of ``folioflow.llm``; between stages the documents are written as Parquet to the shared folder
and read again, so a lost executor never costs more than one stage. All stages but the last return the columns of the
input. The schedule of the mixing stage depends on its documents and ``target_weights`` alone and has no column between
stages, so the last stage computes it for the documents it gets and adds ``mix_block``, ``mix_slot`` and ``mix_offset`` to every row: rows in the
order of (mix_slot, mix_offset) are the mixed corpus. Their handling of nulls, empty and repeated rows is that of their operators; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import block_naming, byte_bpe, mixing, order_minhash, quality
from folioflow.llm.frames import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Target weights of sources by name, against ``OTHERS`` for every source that is not named.
TARGETS: dict[str | None, float] = {"src0": 2}
OTHERS = 1


def target_weights(docs: DataFrame) -> dict:
    """The target weight of every source of these documents."""
    return {r[0]: TARGETS.get(r[0], OTHERS) for r in docs.select(F.col("source").cast("string")).distinct().collect()}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the classifier go."""
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return block_naming.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest doc_id stays."""
    return order_minhash.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which the schedule interleaves their sources to the target weights."""
    return mixing.stage(docs, target_weights(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, with the digest of the bytes they decode to and its place in the mixed corpus."""
    docs = mixing.scheduled(docs, target_weights(docs))
    return byte_bpe.stage(docs, "mix_block", "mix_slot", "mix_offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_tokens),
]
#: The classifier and the alignment cannot be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
