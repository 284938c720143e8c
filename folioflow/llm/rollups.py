"""Token counts as delta-maintained rollups.

Every change of a document is a signed row: an insert adds its count, a delete takes it away, a revised count does both.
A batch of changes is added up by source, language and tokenizer version in the map tasks and committed under its batch
id as one small table; totals are the sums over all committed batches. Committing a batch again replaces what it
committed before, so a replay after a failure counts once.

Source and language may be null and are then groups of their own. A null text has no tokens. Changes whose document
is not known are the caller's to leave out; a null doc_id can be inserted but matches no later change. Rows that repeat
are changes of their own. Groups whose documents are all gone disappear from the totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.frames import table, written
from folioflow.llm.registry import query
from folioflow.session import scratch_path

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions by pattern: words between white space; runs of letters, of digits and of other scripts.
TOKENIZERS = {"words-1": r"[^ \t\n\x0B\f\r]+", "runs-2": r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows of new documents: KEYS and n_tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents away again: KEYS and the n_tokens they were counted with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).cast("long").alias("d_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Signed rows of documents counted anew: KEYS, n_tokens and new_tokens. One row, because both signs share the key."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("d_docs"), (F.col("new_tokens") - F.col("n_tokens")).cast("long").alias("d_tokens"))


class Rollup:
    """Totals kept in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "llm-rollup")

    def commit(self, batch: str, *changes: DataFrame) -> None:
        """Add the signed rows of one batch. The same batch id commits once, however often it is replayed."""
        rows = reduce(DataFrame.unionByName, changes)
        sums = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        """KEYS, n_docs and n_tokens over all committed batches."""
        schema = "source string, lang string, tokenizer string, d_docs long, d_tokens long, batch string"
        rows = self.spark.read.schema(schema).parquet(self.path)
        sums = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def document_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every document by every tokenizer version, before and after its last line is cut, and its labels."""
    cut = F.regexp_replace(F.col("text"), r"\n[^\n]*$", "")
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(t).alias("tokenizer"), count_tokens(F.col("text"), t).alias("n_tokens"), count_tokens(cut, t).alias("new_tokens"))
                    for t in TOKENIZERS
                )
            )
        ).alias("c"),
    ).select("doc_id", "source", "lang", "c.*")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.join(marks, "doc_id", "left")


SQL = r"""
with m as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id),
d as (select source, lang, case when m.toxic = 1 then regexp_replace(text, '\n[^\n]*$', '') else text end as text
      from documents left join m using (doc_id) where m.quality is distinct from 0),
t as (select source, lang, 'words-1' as tokenizer, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as n from d
      union all select source, lang, 'runs-2', len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\x00-\x7F]+')) from d)
select source, lang, tokenizer, count(*) as n_docs, cast(sum(coalesce(n, 0)) as bigint) as n_tokens from t group by source, lang, tokenizer
"""


@query("op4_token_rollups", SQL)
def op4(spark, sf_dir):
    """Insert all documents by both tokenizers, delete the low-quality ones, recount the toxic ones; one batch is replayed."""
    counts = written(document_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "counts")
    low = counts.filter("quality = 0")
    toxic = counts.filter("toxic = 1 and quality is distinct from 0")
    rollup = Rollup(spark)
    rollup.commit("1", inserts(counts))
    rollup.commit("2", deletes(low))
    rollup.commit("2", deletes(low))
    rollup.commit("3", revisions(toxic))
    return rollup.totals()
