"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioflow.plans import QUERIES  # noqa: E402
from folioflow.session import build_session  # noqa: E402

HEADLINE = [
    "multi_search", "merge_hits", "match_alternatives", "match_score", "dedupe_candidates", "resolve_book",
    "clean_content", "norm_keyword", "is_ad_line", "decode_pages", "shred_html", "node_text", "sel_combinators",
    "extract_content", "number_chapters", "record_health", "progress_state", "heartbeat_seconds", "join_book_view",
    "stream_progress", "extract_hits", "extract_toc", "extract_book", "extract_explore",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the clock
    times, failed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # the others still run; a failed query has no time
            failed[name] = str(e)[:200]
            print(name, "failed", failed[name], file=sys.stderr, flush=True)
            continue
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                **({"failed": failed} if failed else {}),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


main()
