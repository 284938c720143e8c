"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import settle

#: Bytes after which a batch of rows that goes to Python ends. A bound on rows alone lets batches grow with the texts.
BATCH = 2_000_000


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches that end at ``BATCH`` bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(BATCH):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a shared intermediate table to the folder in ``spark.checkpoint.dir`` and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    bounded(df.sparkSession)
    return settle(df, f"llm-{label}")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and x, a hash that tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("x"), "text")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, x and the compressed text: what is shuffled is a third of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [squeeze(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], names=["doc_id", "x", "packed"])

    return keyed(docs).mapInArrow(run, "doc_id long, x int, packed binary")
