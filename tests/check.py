"""Compare registered queries with DuckDB: ``python tests/check.py [sf] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import LAST_SQL_SECONDS, compare, duck  # noqa: E402
from seasonlake.plans import ORACLES, QUERIES, load  # noqa: E402
from seasonlake.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    load()
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in ORACLES:
                status, n = compare(df, con, ORACLES[name])
            else:
                status, n = "rows-only", len(df.collect())
        except Exception as error:  # noqa: BLE001 - report and go on
            status, n = f"ERROR {type(error).__name__}: {str(error)[:600]}", -1
        ok = status == "exact" or status == "rows-only"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {n:7d} {time.time() - start:6.2f}s (sql {LAST_SQL_SECONDS[0]:.2f}) {status}", flush=True)
    print(f"{bad} to look at")


main()
