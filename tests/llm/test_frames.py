import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import frames


@pytest.mark.parametrize("way", ["table", "written"])
def test_batches_of_long_texts_are_bounded(spark, tmp_path, way):
    """A batch that goes to Python ends by its bytes, so long texts do not make it larger."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], names=["n", "bytes"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text")).coalesce(1)
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    docs = frames.table(spark, str(tmp_path), "documents") if way == "table" else frames.written(texts, "texts")
    got = docs.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
    assert got[0] == 300 and got[1] < 4_000_000
