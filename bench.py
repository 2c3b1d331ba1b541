"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local width. Each query is run to completion through the noop sink;
derived tables a query shares with others are built inside its own time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from seasonlake.plans import QUERIES, load
from seasonlake.plans.bindings import forget_gold
from seasonlake.session import build_session

HEADLINE = (
    "team_grade", "primary_team", "source_consensus", "two_source_blend", "recency_baseline",
    "rate_fallback", "prior_counters", "rank_suite", "group_percentiles", "asof_snapshot",
    "starter_flag", "points_over_replacement", "outcome_bucket", "isotonic_curve",
    "surplus_board", "percentile_gap", "archetype_rates", "scored_weeks", "shrink_grid",
    "component_projection", "fold_metrics", "field_environment", "coverage", "best_lineup",
    "strategy_summary", "composition_value", "yoy_stability", "text_suite", "json_fields",
    "page_rows", "feature_star", "agg_basics",
)
#: Timed beside the headline and not part of its total.
OTHERS = (
    "benchmark_metrics", "gbt_importance", "opening_strategies", "asof_timestamps", "settings_table", "season_stability",
    "builder_consensus", "file_csv", "table_replace", "report_value_by_round", "report_live_board",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    load()
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_basics"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in (*wanted, *(OTHERS if wanted is HEADLINE else ())):
        forget_gold()
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times[n] for n in wanted), 3),
        "unit": "sec",
        "queries": {n: times[n] for n in wanted},
        "others": {n: s for n, s in times.items() if n not in wanted},
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
