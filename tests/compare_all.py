"""Command line: compare registered queries with their SQL text. ``compare_all.py [dir] [name-part ...]``"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connect  # noqa: E402

from quotemill import build_session  # noqa: E402
from quotemill.plans.registry import load_all  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8,
                          extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, q in load_all().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = q(spark, sf)
            if q.sql is None:
                print(f"rows-only {name}: {df.count()} rows {time.time() - t:.1f}s", flush=True)
                continue
            problems = compare(df, con, q.sql)
        except Exception as e:  # report every query, then fail
            problems = [f"{type(e).__name__}: {str(e)[:900]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok'} {name} {time.time() - t:.1f}s {' | '.join(problems)}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
