"""Source health: checks, summaries, recording, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import text_or_blank
from folioflow.operators.catalog import was_tested
from folioflow.operators.search import cap_per_source

CHECK_KEYWORD = "斗破苍穹"
CHECK_LIMIT = 10
SAMPLES = 3
NO_HITS = "搜索成功但未解析出任何结果，请检查 bookList 及字段规则"
ERROR_MAX = 500


def health_check(runs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per checked source: ok when it returned a hit, count up to 10, first samples, error text.

    ``runs`` has one row per checked source (source_id, error); ``hits`` what the check
    keyword returned.
    """
    few = cap_per_source(hits, CHECK_LIMIT)
    sample = F.struct("item_pos", "name", "author", "book_url")
    got = few.groupBy("source_id").agg(
        F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(sample)), 1, SAMPLES).alias("samples")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    error = text_or_blank(F.col("error"))
    failed = error != ""
    return runs.join(got, "source_id", "left").select(
        "source_id",
        ((n > 0) & ~failed).alias("ok"),
        F.when(failed, 0).otherwise(n).cast("long").alias("hit_count"),
        F.when(failed, F.lit("")).otherwise(
            F.coalesce(F.array_join(F.transform("samples", lambda s: s["name"]), "|"), F.lit(""))
        ).alias("samples"),
        F.when(failed, error).when(n == 0, NO_HITS).otherwise("").alias("error"),
    )


def health_summary(results: DataFrame) -> DataFrame:
    """Total, ok and failed of a batch of checks."""
    return results.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail")
    )


def health_stats(sources: DataFrame) -> DataFrame:
    """Whole catalogue in one pass."""
    return sources.agg(
        F.count("*").alias("total"),
        F.count_if(was_tested() & F.col("last_test_ok")).alias("ok"),
        F.count_if(was_tested() & ~F.col("last_test_ok")).alias("fail"),
        F.count_if(~was_tested()).alias("untested"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run per source; a maximum, so map tasks reduce a hot source on their own."""
    newest = F.max_by(F.struct("tested_at", "ok", "hit_count", "error", "elapsed"), F.struct("tested_at", "event_id"))
    return runs.groupBy("source_id").agg(newest.alias("r")).select("source_id", "r.*")


def record_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """The catalogue with the latest result of each source written into it."""
    r = latest_runs(runs).select(
        F.col("source_id").alias("id"),
        F.col("tested_at").alias("_at"),
        F.col("ok").alias("_ok"),
        F.col("hit_count").alias("_count"),
        F.substring(text_or_blank(F.col("error")), 1, ERROR_MAX).alias("_error"),
        F.col("elapsed").alias("_elapsed"),
    )
    new = {
        "last_test_at": "_at",
        "last_test_ok": "_ok",
        "last_test_count": "_count",
        "last_test_error": "_error",
        "respond_time": "_elapsed",
    }
    joined = sources.join(r, "id", "left")
    return joined.select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in sources.columns])


def invalid_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Tested and failed; untested sources are never selected."""
    out = sources.filter(was_tested() & ~F.col("last_test_ok"))
    return out.filter("enabled") if enabled_only else out


def purge_invalid(sources: DataFrame, scope: DataFrame) -> DataFrame:
    """The catalogue without the failed sources of the scope."""
    doomed = invalid_sources(sources).select("id").join(scope.select("id"), "id", "left_semi")
    return sources.join(doomed, "id", "left_anti")


def first_failures(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The first failures of each batch of checks in test order."""
    w = Window.partitionBy("batch_id").orderBy("tested_at", "event_id")
    failed = runs.filter(~F.col("ok"))
    return failed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
