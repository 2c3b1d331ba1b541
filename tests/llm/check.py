"""Compare the registered queries with DuckDB: ``python tests/llm/check.py sf0.01 [name ...]``."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), os.path.dirname(HERE)]

from oracle import compare, duck  # noqa: E402
from seasonlake.llm.queries import ORACLES, QUERIES  # noqa: E402
from seasonlake.session import build_session  # noqa: E402


def main() -> None:
    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    for name in sys.argv[2:] or QUERIES:
        started = time.time()
        df = QUERIES[name](spark, folder)
        status, n = compare(df, con, ORACLES[name]) if name in ORACLES else ("rows-only", len(df.collect()))
        print(f"{name:20s} {n:7d} {time.time() - started:6.2f}s {status}", flush=True)


main()
