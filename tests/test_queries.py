"""Every registered query against DuckDB on the smallest tables, and its plan."""

import pytest

from oracle import compare, duck
from seasonlake.plans import ORACLES, QUERIES, load

load()
FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"gbt_walk_forward", "gbt_importance"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    status, _ = compare(df, con, ORACLES[name])
    assert status in ("exact", "near"), status


def test_every_query_has_an_oracle_unless_it_learns():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_boosted_projection_shapes(spark):
    df = QUERIES["gbt_walk_forward"](spark, FOLDER).cache()
    assert df.count() > 0
    # the arms never share an entity and season
    assert df.groupBy("entity_id", "target_season").count().where("count > 1").count() == 0
    assert df.where("p10 > p90").count() == 0
    assert {r[0] for r in df.select("arm").distinct().collect()} == {"baseline", "no_baseline"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joined_lines_cross_the_network_once_on_the_way_to_supplier_seasons(spark):
    """Orders are broadcast at this size, so the one exchange is that by supplier and season."""
    assert plan_of(QUERIES["scored_weeks"](spark, FOLDER)).count("Exchange hashpartitioning") == 1


def test_stored_tables_behind_the_archetypes_hold_no_passengers(spark):
    """Neither settings nor names travel with the buckets, and no rank is made for the classes."""
    from seasonlake.plans import bindings

    bindings.forget_gold()
    QUERIES["archetype_class"](spark, FOLDER)
    stored = {key[-1]: set(df.columns) for key, df in bindings._GOLD.items()}
    for name in ("por", "buckets"):
        assert not stored[name] & {"entity_name", "f_pts", "miss_pts", "flex_slots", "points_c", "n_urgent"}, name
    assert not any({"surplus_rank", "projected_surplus_rank"} & columns for columns in stored.values())


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["scan_pruned"](spark, FOLDER))
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan_of(QUERIES["scan_guard"](spark, FOLDER))


def test_one_feed_and_two_feed_prices_agree(spark, as_rows):
    from seasonlake.plans.bindings import Tables
    from seasonlake.plans.consensus import priced

    two = QUERIES["two_source_blend"](spark, FOLDER)
    one = priced(Tables(spark, FOLDER)).select(*two.columns)
    assert as_rows(one, "entity_id", "season") == as_rows(two, "entity_id", "season")


def test_top_k_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["top_per_group"](spark, FOLDER))
    assert "WindowGroupLimit" in plan_of(QUERIES["replacement_level"](spark, FOLDER))


def test_same_rows_for_any_partition_count(spark, as_rows):
    order = ("league_key", "season", "entity_id")
    first = as_rows(QUERIES["points_over_replacement"](spark, FOLDER), *order)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        second = as_rows(QUERIES["points_over_replacement"](spark, FOLDER), *order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == second


def test_backtest_broadcasts_only_what_it_has_measured(spark, monkeypatch):
    """File sizes decide no broadcast: stored keys take many times more on the driver."""
    from seasonlake import session
    from seasonlake.operators import ranking
    from seasonlake.plans import bindings, rates, reports

    plans, pinned = [], session.pinned

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pinned(df)

    for module in (bindings, rates, ranking):
        monkeypatch.setattr(module, "pinned", watched)
    before = {name: spark.conf.get(name, None) for name in session.MEASURED}
    bindings.forget_gold()
    found = reports.report_backtest_pivot(bindings.Tables(spark, FOLDER))
    bindings.forget_gold()
    joins = [plan.count("Join ") for plan in plans]
    broadcast = [plan.count("BroadcastHashJoin ") for plan in plans]
    assert sum(joins) > 20 and sum(broadcast) == 1  # the 25 nations, by a hint
    assert {name: spark.conf.get(name, None) for name in session.MEASURED} == before
    assert found.columns == ["target_season", "model", "prior_points", "prior_ppg", "league_mean"]
