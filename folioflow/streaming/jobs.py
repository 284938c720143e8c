"""Streams: search results, health checks, alternatives, reading activity.

The aggregates are the batch expressions in update mode, so state is one row per key and
map tasks reduce a hot key before the shuffle. Late and out-of-order events count: the
newest client time wins for positions, and seconds are sums, so no watermark drops rows.

Every job takes a ``path`` for its log and results: run again with the same path, it goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import alternatives as alt
from folioflow.operators import merge, search
from folioflow.operators.library import progress_state
from folioflow.operators.numbering import previous
from folioflow.streaming.runner import latest, read_landed, run_each, run_to_table, table_path

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_search(hits: DataFrame, sources: DataFrame, query: str, path: str | None = None) -> DataFrame:
    """Merged entries so far, updated as hits land. ``sources`` is a table."""
    scored = search.with_score(search.union_hits(hits, sources), query)
    scored = scored.withColumn("score", F.round("score", 6))
    return latest(run_to_table(merge.merge_hits_simple(scored), "update", "stream-search", path, ["merge_key"]), ["merge_key"])


def stream_health(runs: DataFrame, path: str | None = None) -> DataFrame:
    """Running total, ok and failed per batch of checks."""
    counts = runs.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail")
    )
    return latest(run_to_table(counts, "update", "stream-health", path, ["batch_id"]), ["batch_id"])


def stream_progress(events: DataFrame, path: str | None = None) -> DataFrame:
    """Reading state per book, updated as events land."""
    return latest(run_to_table(progress_state(events), "update", "stream-progress", path, ["book_id"]), ["book_id"])


def _outcomes(responses: DataFrame, keys: list[str], label: str, path: str | None) -> DataFrame:
    """The last outcome of every source that has responded: keys, source_id, ok, hit_count, error."""
    last = F.max_by(F.struct("ok", "hit_count", "error"), F.struct("responded_at", "response_id"))
    told = responses.groupBy(*keys, "source_id").agg(last.alias("r")).select(*keys, "source_id", "r.*")
    by = [*keys, "source_id"]
    return latest(run_to_table(told, "update", label, path, by), by)


def stream_search_progress(responses: DataFrame, asked: DataFrame, path: str | None = None) -> DataFrame:
    """Counters of running searches: search_id, total, done, succeeded, failed, hits.

    ``responses``: search_id, source_id, ok, hit_count, error, responded_at, response_id, one row for each answer of a
    source as it lands; of several the last one counts. ``asked``: a table of (search_id, source_id). A source that
    failed counts as done, and its hits do not. State is one row for each source that has answered.
    """
    return _counted(_outcomes(responses, ["search_id"], "stream-search-progress", path), asked, "search_id", "done")


def stream_alternatives_progress(responses: DataFrame, asked: DataFrame, path: str | None = None) -> DataFrame:
    """Counters of running searches for alternatives: book_id, total, responded, succeeded, failed, hits; see above."""
    return _counted(_outcomes(responses, ["book_id"], "stream-alternatives-progress", path), asked, "book_id", "responded")


def _counted(told: DataFrame, asked: DataFrame, key: str, done: str) -> DataFrame:
    rows = asked.select(key, "source_id").distinct().join(told, [key, "source_id"], "left")
    return rows.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count("ok").alias(done),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum(F.when(F.col("ok"), F.col("hit_count")).otherwise(0)).cast("long").alias("hits"),
    )


CANDIDATE = "source_id long, book_url string, score int, source_name string"


def stream_alternatives(
    found: DataFrame, books: DataFrame, limit: int = alt.TOP, path: str | None = None
) -> DataFrame:
    """Best alternatives per book, refined with every micro-batch of search results.

    Each batch is matched on its own and its best ``limit`` candidates per book land as files; a second stream keeps the best
    score of every candidate (book, source and link) and puts out the candidates it has touched, and no others. State is one row
    for each candidate, so a book needs no list of its own and no Python; a candidate that lands twice counts once, so a
    repeated batch changes nothing. Of what is kept, the best ``limit`` per book are the result.
    """
    spark = books.sparkSession
    columns = f"book_id long, {CANDIDATE}"
    start = spark.createDataFrame([], columns)
    landed = table_path(spark, "stream-candidates", f"{path}/candidates" if path else None, start)

    def step(batch: DataFrame, epoch: int) -> None:
        new = alt.match_alternatives(books, batch, limit=limit)
        new.select(*start.columns).write.mode("overwrite").parquet(f"{landed}/epoch={epoch}")

    run_each(found, step, "append", "stream-candidates", f"{path}/candidates" if path else None)
    stream = read_landed(spark, f"{landed}/epoch=*", start.schema)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        by = ["book_id", "source_id", "book_url"]
        # The higher score stays, and on ties the larger name.
        best = stream.groupBy(*by).agg(F.max(F.struct("score", "source_name")).alias("best")).select(*by, "best.*")
        table = run_to_table(best, "update", "stream-alternatives", path, by)
    finally:
        spark.conf.set(STORE, before)
    return alt.top_alternatives(latest(table, by), limit)


def stream_heartbeat(ticks: DataFrame, block_seconds: int = 900, path: str | None = None) -> DataFrame:
    """Reading seconds per book from ticks that land in any order.

    State is the set of ticks of each block of a book's time, so a late tick splits the gap it falls into and a book with a third of
    all ticks is spread over its blocks. A batch puts out the blocks it has touched; gaps inside blocks are counted from
    their sets, those between blocks from their first and last ticks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    blocks = ticks.filter("ts is not null").groupBy("book_id", F.floor(micros / (block_seconds * 1_000_000)).alias("block")).agg(
        F.array_sort(F.collect_set(micros)).alias("at"), F.count("*").alias("ticks")
    )
    by = ["book_id", "block"]
    now = latest(run_to_table(blocks, "update", "stream-heartbeat", path, by), by)

    def counted(gap):
        seconds = F.floor(gap / 1_000_000 + 0.5)
        return F.when((seconds > 0) & (seconds < 600), seconds).otherwise(0)

    gaps = F.zip_with(F.slice("at", 2, F.size("at")), F.col("at"), lambda b, a: F.coalesce(counted(b - a), F.lit(0)))
    inner = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    rows = now.select("book_id", "block", "ticks", inner.alias("inner"), F.get("at", F.lit(0)).alias("first"), F.element_at("at", -1).alias("last"))
    # The last tick before a block is the last one of the block before it.
    rows = previous(rows.withColumn("edge", F.struct("block", "last")), ["book_id"], F.floor(F.col("block") / 4096), "edge", "before")
    between = F.coalesce(counted(F.col("first") - F.col("before.last")), F.lit(0))
    return rows.groupBy("book_id").agg(F.sum(F.col("inner") + between).cast("long").alias("seconds"), F.sum("ticks").alias("ticks"))
