"""Run registered queries next to their SQL: check.py [sf_dir] [name ...]."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import compare, duck  # noqa: E402

from folioflow.plans import ORACLE, QUERIES  # noqa: E402
from folioflow.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                out = compare(df, con, ORACLE[name]) or "ok"
            else:
                out = f"ok (rows only: {df.count()})"
        except Exception as e:
            out = "ERROR " + str(e)[:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not out.startswith("ok")
        print(f"{name:24s} {time.time() - t:6.2f}s {out}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


main()
