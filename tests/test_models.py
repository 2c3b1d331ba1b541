"""Operators against brute force and against the properties they promise."""

import itertools
import math
import random

import pytest
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from seasonlake.functions import stats
from seasonlake.operators import (
    asof, blend, curve, environment, folds, grades, history, learn, lineup, outcomes, rates,
    replacement, settings, shrinkage, strategy,
)
from seasonlake.plans import learned
from seasonlake.session import pinned


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- expressions -----------------------------------------------------------------


@pytest.mark.parametrize("nu,t", [(1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (10, 2.228), (31, 2.040)])
def test_student_tail_at_tabulated_points(spark, nu, t):
    df = frame(spark, [(t, nu), (-t, nu)], "t double, nu long")
    for (p,) in df.select(stats.student_two_sided(F.col("t"), F.col("nu"))).collect():
        assert p == pytest.approx(0.05, abs=1e-4)


def test_null_aware_expressions(spark, as_rows):
    df = frame(spark, [(1.0, 3.0), (2.0, None), (None, None), (-4.0, 0.0)], "a double, b double")
    got = df.select(
        stats.mean_of([F.col("a"), F.col("b")]).alias("m"), stats.blend_two(F.col("a"), F.col("b")).alias("blend"),
        stats.floor_at(F.col("a"), 0.0).alias("f"), stats.cap_at(F.col("a"), 1.0).alias("c"),
    )
    assert [tuple(r) for r in got.collect()] == [(2.0, 2.0, 1.0, 1.0), (2.0, 2.0, 2.0, 1.0), (None, None, None, None), (-2.0, -2.0, 0.0, -4.0)]


def test_weighted_mean_skips_null_in_both_sums(spark):
    df = frame(spark, [(10.0, 10), (None, 9), (20.0, 8)], "x double, w int")
    assert df.agg(stats.weighted_mean(F.col("x"), F.col("w"))).first()[0] == pytest.approx((100 + 160) / 18)


def test_correlation_of_a_constant_is_null(spark):
    df = frame(spark, [(1.0, float(i)) for i in range(5)], "x double, y double")
    assert df.agg(stats.correlation(F.col("x"), F.col("y"))).first()[0] is None


# --- grades, blends, rates ---------------------------------------------------------


def test_missing_side_ranks_last(spark, as_rows):
    left = frame(spark, [(1, "a", 0.1), (1, "b", 0.2)], "season int, team string, p double")
    right = frame(spark, [(1, "b", 3.0), (1, "c", 4.0)], "season int, team string, r double")
    got = as_rows(grades.paired_grades(left, right, ["season", "team"], ["season"], "p", "r", "pg", "rg", "g"), "team")
    assert [(r["team"], r["pg"], r["rg"]) for r in got] == [("a", 100.0, 100.0), ("b", 50.0, 0.0), ("c", 0.0, 50.0)]
    off = as_rows(grades.paired_grades(left, right, ["season", "team"], ["season"], "p", "r", "pg", "rg", "g", null_grade=True), "team")
    assert [r["g"] for r in off] == [None, 25.0, None]


def test_primary_team_tie_breaks(spark, as_rows):
    rows = [(1, "x", 1), (1, "x", 2), (1, "y", 3), (1, "y", 4), (2, "b", 5), (2, "a", 5), (3, None, 1)]
    got = as_rows(grades.primary_team(frame(spark, rows, "k int, team string, week int"), ["k"], "team", "week"), "k")
    assert got == [{"k": 1, "team": "y"}, {"k": 2, "team": "a"}]


def test_consensus_sources_add_up(spark, as_rows):
    rows = [("p1", "a", 10.0), ("p1", "b", 20.0), ("p2", "a", 5.0), ("p3", "b", None), (None, "a", 1.0)]
    got = as_rows(blend.consensus(frame(spark, rows, "id string, source string, v double"), ["id"], "v", ["a", "b"]), "id")
    assert [r["id"] for r in got] == ["p1", "p2"]
    for r in got:
        assert r["num_sources"] == sum(r[f"{s}_points"] is not None for s in "ab")
    assert got[0]["median_p50"] == 15.0 and got[0]["floor_p20"] == 12.0 and got[1]["stddev_points"] is None


def test_blend_counts_only_voting_sources(spark, as_rows):
    a = frame(spark, [("x", 1, 4.0)], "id string, season int, a double")
    b = frame(spark, [("x", 1, 6.0, 1.0), ("y", 1, None, 9.0)], "id string, season int, b double, other double")
    got = as_rows(blend.two_source_blend(a, b, ["id", "season"], "a", "b", "price"), "id")
    assert [(r["price"], r["num_sources"]) for r in got] == [(5.0, 2), (None, 0)]


def test_ambiguous_keys_are_rejected(spark, as_rows):
    ids = frame(spark, [("k", "QB", 1), ("k", "QB", 2), ("m", "QB", 3), ("m", "QB", 3)], "key string, position string, id int")
    assert as_rows(blend.reject_ambiguous(ids, ["key", "position"], "id")) == [{"key": "m", "position": "QB", "id": 3}]


def test_thin_group_borrows_the_pooled_rate(spark, as_rows):
    df = frame(spark, [(1, "wide", 60.0, 9000.0), (1, "thin", 3.0, 9.0)], "season int, pos string, td double, yd double")
    got = as_rows(rates.rate_with_fallback(df, ["season"], ["pos"], {"r": ("td", "yd")}, 5000), "pos")
    assert got[0]["r"] == pytest.approx(63 / 9009) and got[1]["r"] == pytest.approx(60 / 9000)


# --- history -----------------------------------------------------------------------


def test_baseline_window_weights_and_floor(spark, as_rows):
    rows = [("a", 2015, 16, 99.0), ("a", 2016, 16, 10.0), ("a", 2018, 3, 50.0), ("a", 2019, 16, None), ("a", 2020, 8, 20.0)]
    df = frame(spark, rows, "entity_id string, season long, games long, ppg double")
    got = {r["target_season"]: r for r in as_rows(history.recency_baseline(df, ["ppg"]))}
    assert sorted(got) == [2016, 2017, 2018, 2019, 2020, 2021]
    assert got[2021]["seasons_used"] == 2 and got[2021]["games_used"] == 24
    assert got[2021]["weighted_ppg"] == pytest.approx(20.0)
    assert got[2017]["weighted_ppg"] == pytest.approx((10 * 1.0 + 99 * 0.9) / 1.9)


def test_prior_counters_ignore_the_current_season(spark, as_rows):
    df = frame(spark, [("a", 1, True), ("a", 2, False), ("a", 4, True)], "entity string, season int, f boolean")
    got = as_rows(history.prior_counters(df, ["entity"], F.col("f")), "season")
    assert [(r["prior_seasons"], r["prior_elite"], r["elite_last_season"]) for r in got] == [(0, 0, 0), (1, 1, 1), (2, 1, 0)]


def test_slice_means_see_earlier_seasons_only(spark, as_rows):
    rows = [("a", 1, 10.0), ("a", 1, None), ("b", 2, 4.0), ("a", 3, 100.0), ("c", 3, None), ("b", 5, 1.0), ("a", 5, 2.0)]
    got = as_rows(history.slice_means(frame(spark, rows, "g string, season long, v double"), ["g"], "v", "m"), "season", "g")
    assert [(r["g"], r["season"], r["m"]) for r in got] == [
        ("a", 1, None), ("b", 2, 10.0), ("a", 3, 10.0), ("c", 3, 7.0), ("a", 5, 55.0), ("b", 5, 4.0),
    ]


def test_backtest_table_adds_newcomers_and_games(spark, as_rows):
    rng = random.Random(6)
    schema = "s long, pos string, id long, actual double, predicted double, naive double, market double"
    old = frame(spark, [(s, p, i, rng.random(), rng.random(), rng.random(), None) for s in (1, 2) for p in "xy" for i in range(15)], schema)
    new = frame(spark, [(2, "x", 100 + i, 2.0 + i, 1.0 + i, 5.0 if s else None, float(i)) for s in (0, 1) for i in range(12)], schema)
    games = folds.games_metrics(
        frame(spark, [(1, 4.0, 3.0, 8.0), (1, None, 1.0, 1.0), (2, 2.0, 2.0, 2.0)], "s long, a double, e double, n double"), ["s"], "a", "e", "n"
    )
    out = as_rows(folds.backtest_table(old, new, games, ["s"], "pos", "actual", "predicted", "naive", "market", "id", min_rows=10), "s", "pos")
    assert [(r["s"], r["pos"], r["n"]) for r in out] == [
        (1, "ALL", 30), (1, "x", 15), (1, "y", 15), (2, "ALL", 30), (2, "NO_BASELINE", 12), (2, "x", 15), (2, "y", 15),
    ]
    assert [(r["games_n"], r["games_mae"], r["games_naive_mae"]) for r in out if r["pos"] == "ALL"] == [(1, 1.0, 4.0), (1, 0.0, 0.0)]
    fresh = next(r for r in out if r["pos"] == "NO_BASELINE")
    assert (fresh["mae"], fresh["naive_mae"], fresh["games_n"]) == (1.0, pytest.approx(sum(abs(i - 3) for i in range(12)) / 12), None)
    assert fresh["market_n"] == 12 and fresh["market_spearman"] == pytest.approx(-1.0)


def test_forward_asof_edges(spark, as_rows):
    snaps = frame(spark, [(1, 2025, "2025-09-01"), (2, 2025, "2025-09-04"), (3, 2025, "2025-09-05"), (4, 2025, "2026-03-01")], "id int, season int, d string")
    weeks = frame(spark, [(2025, 1, "2025-09-04"), (2025, 2, "2025-09-11")], "season int, week int, first_game string")
    got = as_rows(asof.forward_asof(snaps, weeks, ["season"], "d", "first_game", "week"), "id")
    assert [(r["id"], r["week"]) for r in got] == [(1, 1), (2, 1), (3, 2)]
    kept = as_rows(asof.latest_per_label(asof.forward_asof(snaps, weeks, ["season"], "d", "first_game", "week"), ["season"], "week", "d"), "id")
    assert [r["id"] for r in kept] == [2, 3]


def test_forward_asof_over_ranges(spark):
    """A hot group of timestamps over many ranges, ties and empty stretches, against bisection."""
    rng = random.Random(8)
    groups = ["hot"] * 6 + ["a", "b", None, "lonely"]
    snaps = [(i, rng.choice(groups), None if i % 97 == 0 else rng.randrange(100_000)) for i in range(6000)]
    bounds = [(g, rng.randrange(20_000, 90_000), rng.randrange(1000)) for _ in range(300) for g in ("hot", "a", "b")] + [("hot", 95_000, 5), ("hot", 95_000, 3)]
    df = frame(spark, snaps, "id long, g string, s long").withColumn("s", F.timestamp_seconds("s"))
    days = frame(spark, bounds, "g string, b long, label int").withColumn("b", F.timestamp_seconds("b"))
    ordered = {}
    for g, b, label in bounds:
        old = ordered.setdefault(g, {})
        old[b] = min(label, old.get(b, label))
    want = {}
    for i, g, s in snaps:
        later = [b for b in ordered.get(g, {}) if s is not None and b >= s]
        if later:
            want[i] = ordered[g][min(later)]
    conf = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = asof.forward_asof(df, days, ["g"], "s", "b", "label")
        assert out.columns == ["id", "g", "s", "label"]
        assert {r["id"]: r["label"] for r in out.collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert asof.forward_asof(df.limit(0), days, ["g"], "s", "b", "label").count() == 0


# --- replacement, lineup -------------------------------------------------------------


def brute_levels(pool, teams, slots, flex):
    ranked = {p: sorted((r for r in pool if r[1] == p), key=lambda r: (-r[2], r[0])) for p in slots}
    starters = {p: teams * n for p, n in slots.items()}
    taken = {p: ranked[p][: starters[p]] for p in slots}
    for count, eligible in flex:
        queue = sorted((r for p in eligible for r in ranked[p] if r not in taken[p]), key=lambda r: (-r[2], r[0]))
        for r in queue[: teams * count]:
            taken[r[1]].append(r)
            starters[r[1]] += 1
    return {p: (starters[p], ranked[p][min(starters[p], len(ranked[p]) - 1)][2]) for p in slots if ranked[p]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replacement_levels_match_brute_force(spark, as_rows, seed):
    rng = random.Random(seed)
    pool = [(i, rng.choice("QRWT"), float(rng.randrange(40))) for i in range(60)] + [(100, "T", 3.0)]
    slots = {"Q": 1, "R": 2, "W": 2, "T": 1}
    league = {"league_key": "x", "team_count": 5, "q": 1, "r": 2, "w": 2, "t": 1, "f": 2, "s": 1}
    columns = {"Q": "q", "R": "r", "W": "w", "T": "t"}
    flex = [("f", "RWT"), ("s", "QRWT")]
    df = settings.with_settings(frame(spark, pool, "entity_id long, position string, league_points double"), [league], list(league))
    depth = replacement.deepest_rank([league], columns, [(c, list(e)) for c, e in flex])
    got = as_rows(replacement.replacement_levels(df, ["league_key"], columns, [(c, list(e)) for c, e in flex], depth), "position")
    want = brute_levels(pool, 5, slots, [(2, "RWT"), (1, "QRWT")])
    assert {r["position"]: (r["starters_at_position"], r["replacement_level_points"]) for r in got} == want


def test_lineup_is_the_best_assignment(spark, as_rows):
    rng = random.Random(5)
    rows = [(t, i, rng.choice("QRW"), float(rng.randrange(100)), 1, 1, 1, 1, 1) for t in range(6) for i in range(9)]
    df = frame(spark, rows, "team int, entity_id int, position string, league_points double, q int, r int, w int, f int, s int")
    got = as_rows(lineup.lineup_value(df, ["team"], {"Q": "q", "R": "r", "W": "w"}, [("f", ["R", "W"]), ("s", ["Q", "R", "W"])]), "team")
    for result in got:
        roster = [(r[2], r[3]) for r in rows if r[0] == result["team"]]
        best = 0.0
        for size in range(6):
            for pick in itertools.combinations(roster, size):
                q, r, w = (sum(p == x for p, _ in pick) for x in "QRW")
                over_q, over = max(q - 1, 0), max(r - 1, 0) + max(w - 1, 0)
                if over_q <= 1 and over <= 2 and over_q + over <= 2:
                    best = max(best, sum(v for _, v in pick))
        assert result["starter_points"] == best


def test_snake_and_variants(spark, as_rows):
    turn, team = lineup.snake(F.col("id"), F.lit(3))
    got = [tuple(r) for r in spark.range(1, 8).select(turn, team).collect()]
    assert got == [(1, 1), (1, 2), (1, 3), (2, 3), (2, 2), (2, 1), (3, 1)]
    df = frame(spark, [("a", 1, 2, 0, 6), ("b", 1, 0, 1, 6), ("c", 1, 0, 0, 6)], "k string, qb_slots int, flex_slots int, superflex_slots int, bench_slots int")
    rows = {(r["k"], r["variant"]): r for r in as_rows(lineup.format_variants(df, ["qb_slots"]))}
    pick = {k: (r["flex_slots"], r["superflex_slots"], r["bench_slots"], r["rounds"], r["qb_cap"], r["is_actual"]) for k, r in rows.items()}
    assert pick[("a", "1qb")] == (2, 0, 6, 9, 2, True) and pick[("a", "superflex")] == (1, 1, 6, 9, 4, False)
    assert pick[("b", "1qb")] == (1, 0, 6, 8, 2, False) and pick[("c", "superflex")] == (0, 1, 5, 7, 4, False)


def test_openings(spark):
    """Recursive queries against itertools, the label and the counts included."""
    caps = {"QB": 2, "RB": 5, "WR": 5, "TE": 2}
    want = set()
    for combo in itertools.combinations_with_replacement(caps, 5):
        counts = {n: combo.count(n) for n in caps if n in combo}
        if all(c <= caps[n] for n, c in counts.items()):
            want.add(("".join(f"{c}{n}" for n, c in counts.items()), tuple(sorted(counts.items()))))
    found = {(r["label"], tuple(sorted(r["counts"].items()))) for r in lineup.compositions(spark).collect()}
    assert found == want and len(found) == 36
    for counts in ({"RB": 3, "WR": 2}, {"RB": 2, "WR": 3, "TE": 0}, {"QB": 1}):
        picks = [n for n, c in counts.items() for _ in range(c)]
        got = [r["sequence"] for r in lineup.orderings(spark, counts).collect()]
        assert sorted(got) == sorted({"-".join(p) for p in itertools.permutations(picks)})


def test_settings_table_of_any_size(spark, monkeypatch):
    """5000 settings rows in chunks, a handful broadcast, none at all: the same product."""
    facts = spark.range(7).withColumn("x", F.col("id") * 2)
    table = spark.range(5000).select(F.col("id").alias("league_key"), (F.col("id") % 9).alias("price"), F.lit("extra").alias("x"))
    out = settings.with_settings(facts, table, ["league_key", "price"])
    assert out.columns == ["id", "x", "league_key", "price"]
    assert "BroadcastNestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 35_000 == out.distinct().count() and out.where("price <> league_key % 9").count() == 0
    few = settings.with_settings(facts, table.where("league_key < 3"), ["league_key", "price"])
    assert few.count() == 21 == few.distinct().count()
    assert settings.with_settings(facts, table.limit(0), ["league_key"]).count() == 0


def test_copied_side_of_a_settings_join_is_never_broadcast(spark, monkeypatch):
    """Stored tables look small to the planner, their copies are not."""
    monkeypatch.setattr(settings, "BROADCAST_SETTINGS", 100)
    facts = pinned(spark.range(700).withColumn("x", F.col("id") * 2))
    table = pinned(spark.range(3000).select(F.col("id").alias("league_key"), (F.col("id") % 9).alias("price")))

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    both = settings.with_settings(facts, table, ["league_key", "price"])
    assert "BroadcastHashJoin" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
    few = settings.with_settings(facts.where("id < 50"), table, ["league_key", "price"])
    assert "BroadcastHashJoin" in plan_of(few) and "BuildLeft" in plan_of(few)
    for out, n in ((both, 700 * 3000), (few, 50 * 3000)):
        assert out.count() == n and out.select("id", "league_key").distinct().count() == n
        assert out.where("price <> league_key % 9 OR x <> id * 2").count() == 0


def test_whole_points_are_priced_exactly(spark):
    big = 2**53 + 1
    df = frame(spark, [(3, big, 7, 101)], "a long, b long, pa long, pb long")
    got = df.select(settings.linear_points({"a": "pa", "b": "pb"}).alias("p")).first()["p"]
    assert got == 21 + big * 101


def test_squared_errors_of_whole_numbers_do_not_overflow(spark):
    df = spark.range(4).select(F.lit(3_000_000_000).alias("a"), (F.col("id") * 0).alias("p"))
    got = df.agg(*[c.alias(n) for n, c in stats.error_metrics(F.col("a"), F.col("p")).items()]).first()
    assert got["rmse"] == 3e9 == got["mae"] and got["n"] == 4 and got["r2"] is None


def test_floor_stays_below_ceiling_when_fewer_than_no_games_are_expected(spark):
    df = frame(spark, [(5.0, -0.5, 12.0, 3.0, 9.0), (5.0, 2.0, 12.0, 3.0, 9.0), (5.0, -0.5, 12.0, None, None)],
               "rate double, games double, role_games double, p10 double, p90 double")
    got = learn.season_totals(df, "rate", "games").select("projected_points_floor", "projected_points_ceiling").collect()
    assert [tuple(r) for r in got] == [(-4.5, -1.5), (6.0, 18.0), (None, None)]


def test_in_every_group_counts_groups_without_a_hit(spark):
    every = frame(spark, [("a", "x"), ("a", "y"), ("b", "x")], "strategy string, league string")
    good = every.where("league = 'x'")
    assert [r[0] for r in strategy.in_every_group(good, "strategy", "league", every).collect()] == []
    assert sorted(r[0] for r in strategy.in_every_group(good, "strategy", "league").collect()) == ["a", "b"]


# --- curve, shrinkage ----------------------------------------------------------------


def brute_isotonic(points):
    total = [sum(y for _, y, _ in points[i:j + 1]) / sum(w for _, _, w in points[i:j + 1]) for i in range(len(points)) for j in range(i, len(points))]
    index = {(i, j): v for (i, j), v in zip(((i, j) for i in range(len(points)) for j in range(i, len(points))), total)}
    n = len(points)
    return [min(max(index[i, j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_monotone_curve(spark):
    rng = random.Random(11)
    points = [(float(x), rng.uniform(0, 100) - x, float(rng.randrange(1, 5))) for x in range(1, 40)]
    points = [(x, y * w, w) for x, y, w in points]
    df = frame(spark, [("g", *p) for p in points], "g string, x double, total double, weight double")
    curves = curve.monotone_points(df, ["g"], "x", "total", "weight")
    at = frame(spark, [("g", p[0]) for p in points] + [("g", 0.0), ("g", 99.0), ("g", 7.5), ("g", None), ("none", 3.0)], "g string, at double")
    found = curve.curve_at(curves, at, ["g"], "at", "y").collect()
    assert [r["y"] for r in found if r["g"] == "none"] == [None] and len(found) == 43
    got = {r["at"]: r["y"] for r in found if r["g"] == "g"}
    want = dict(zip((p[0] for p in points), brute_isotonic(points)))
    for x, y in want.items():
        assert got[x] == pytest.approx(y, rel=1e-9)
    assert got[0.0] == pytest.approx(want[1.0]) and got[99.0] == pytest.approx(want[39.0])
    assert got[7.5] == pytest.approx((want[7.0] + want[8.0]) / 2)


def test_curves_of_many_groups_are_one_fit(spark, monkeypatch):
    """Groups of very different level and size, one of a single point, against brute force."""
    rng = random.Random(5)
    data = {
        f"g{k}": [(float(x), (rng.uniform(0, 50) - x + 10 ** (k % 5)) * w, w) for x, w in
                  ((x, float(rng.randrange(1, 9))) for x in range(-3, rng.randrange(0, 30)))]
        for k in range(12)
    }
    data["one"] = [(4.0, 8.0, 2.0)]
    df = frame(spark, [(g, *p) for g, points in data.items() for p in points], "g string, x double, total double, weight double")
    found = curve.monotone_points(df, ["g"], "x", "total", "weight").collect()
    assert len(found) == sum(map(len, data.values()))
    want = {(g, p[0]): y for g, points in data.items() for p, y in zip(points, brute_isotonic(points))}
    for r in found:
        assert r["y"] == pytest.approx(want[r["g"], r["x"]], rel=1e-9, abs=1e-9)
    assert curve.monotone_points(df.limit(0), ["g"], "x", "total", "weight").collect() == []
    monkeypatch.setattr(curve, "MOST_POINTS", 5)
    with pytest.raises(ValueError, match="bin x"):
        curve.monotone_points(df, ["g"], "x", "total", "weight")


def test_curve_never_sees_its_own_season(spark):
    rng = random.Random(2)
    rows = [("g", s, x, rng.uniform(0, 50) - x) for s in range(2010, 2016) for x in range(30)]
    def fit(data):
        df = frame(spark, data, "g string, season long, x long, y double")
        out = curve.walk_forward_curve(df, ["g"], "x", "y", F.lit(2016).cast("long"))
        made = {}
        for r in out.orderBy("season", "x").collect():
            made.setdefault(r["season"], (r["curve_train_seasons"], []))[1].append((r["x"], r["y"]))
        return made
    before = fit(rows)
    after = fit([(g, s, x, 1e6 if s >= 2014 else y) for g, s, x, y in rows])
    assert sorted(before) == [2013, 2014, 2015, 2016] and before[2013][0] == 3
    assert before[2014] == after[2014] and before[2015] != after[2015]


def test_best_k_matches_a_direct_search(spark):
    rng = random.Random(4)
    pairs = [("m", s, float(rng.randrange(20)), float(rng.randrange(20, 90)), rng.random() / 3, float(rng.randrange(1, 90))) for s in (1, 2, 3) for _ in range(30)]
    df = frame(spark, pairs, "metric string, season long, num double, den double, actual double, weight double")
    priors = frame(spark, [("m", 2, 0.2), ("m", 4, 0.17), ("m", 1, 0.3)], "metric string, target_season long, prior double")
    grid = (10, 25, 50, 100, 200)
    got = {r["target_season"]: r["k"] for r in shrinkage.best_k(df, priors, F.lit(4).cast("long"), grid).collect()}
    for target, prior in ((2, 0.2), (4, 0.17)):
        train = [p for p in pairs if p[1] < target]
        def error(k):
            return sum(w * ((n + k * prior) / (d + k) - y) ** 2 for _, _, n, d, y, w in train) / sum(p[5] for p in train)
        assert got[target] == min(grid, key=error)
    assert got[1] == 50


def test_incumbency_labels(spark, as_rows):
    roster = frame(spark, [("a", 2, "x"), ("b", 2, "y"), ("c", 2, "z")], "entity_id string, season long, team string")
    seasons = frame(spark, [("a", 1, "x"), ("b", 1, "x"), ("c", 0, "z")], "entity_id string, season long, team string")
    got = as_rows(shrinkage.incumbency(roster, seasons), "entity_id")
    assert [r["incumbency"] for r in got] == ["incumbent", "new_team", "unproven"]


# --- outcomes, strategy, folds ---------------------------------------------------------


def test_archetypes_partition_everyone_known(spark):
    rows = [(p, a, e) for p in (0, 1) for a in (None, 22, 27, 31) for e in (None, 0, 2, 3, 6)]
    df = frame(spark, rows, "prior int, age int, experience int").withColumn(
        "cell", outcomes.archetype(F.col("prior"), F.col("age"), F.col("experience"))
    )
    for r in df.collect():
        known = r["age"] is not None and r["experience"] is not None
        assert (r["cell"] is not None) == known
    assert df.where("prior = 0 AND age = 31 AND experience = 2").first()["cell"] == "Unproven Youth"
    assert df.where("prior = 1 AND age = 22 AND experience = 0").first()["cell"] == "Proven Prime"


def test_identical_members_have_no_edge_and_no_test(spark, as_rows):
    rows = [("control", s, d, 10.0 / 3, 4) for s in range(5) for d in range(4)]
    df = frame(spark, rows, "strategy string, season int, slot int, starter_points double, team_count int")
    trial = strategy.against_field(df, ["season"])
    assert trial.where("abs(points_vs_field) > 1e-9 OR finish_rank <> 1").count() == 0
    got = as_rows(strategy.strategy_summary(trial, ["strategy"]))[0]
    assert got["t_stat"] is None and got["p_value"] is None and got["seasons_positive"] == 0


def test_clustered_test_by_hand(spark, as_rows):
    means = [1.0, 2.0, 4.0, -1.0]
    rows = [("a", s, m + d) for s, m in enumerate(means) for d in (-0.5, 0.5)] + [("b", 0, 3.0)]
    got = {r["g"]: r for r in as_rows(folds.clustered_test(frame(spark, rows, "g string, s int, v double"), ["g"], "s", "v"))}
    mean, sd = 1.5, math.sqrt(sum((m - 1.5) ** 2 for m in means) / 3)
    assert got["a"]["t_stat"] == pytest.approx(mean / (sd / 2)) and got["a"]["clusters_positive"] == 3
    assert got["b"]["t_stat"] is None


def test_fold_metrics_of_a_constant_prediction(spark, as_rows):
    rows = [("c", i, float(i), 5.0) for i in range(12)] + [("p", i, float(i), float(i)) for i in range(12)]
    got = {r["g"]: r for r in as_rows(folds.fold_metrics(frame(spark, rows, "g string, id int, y double, p double"), ["g"], "y", "p", "id"))}
    assert got["c"]["spearman"] is None and got["c"]["top5_hits"] is None
    assert got["p"]["spearman"] == pytest.approx(1.0) and got["p"]["top5_hits"] == 5 and got["p"]["mae"] == 0.0


def test_quantile_bins_drop_equal_edges(spark):
    df = frame(spark, [(float(v),) for v in [0] * 50 + list(range(1, 51))], "v double")
    bins = [r[0] for r in folds.quantile_bins(df, "v", 10).select("bin").distinct().collect()]
    assert sorted(bins) == list(range(1, 7))


def test_environment_flags(spark):
    df = frame(spark, [(1, None, 0), (0, None, 0), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(environment.residual_flag([F.col("a"), F.col("b"), F.col("c")])).collect()] == [0, 1, 1]


# --- learners ----------------------------------------------------------------------------


def test_walk_forward_learner_has_no_leak_and_ranks_features(spark):
    rng = random.Random(8)
    rows = []
    for s in range(2000, 2005):
        for i in range(120):
            x, noise = rng.uniform(0, 10), rng.uniform(0, 10)
            rows.append((i, s, x, None if i % 3 == 0 else noise, 3 * x + rng.uniform(-1, 1)))
    schema = "id long, target_season long, x double, noise double, y double"
    models = {"p": ("y", ["x", "noise"])}
    def run(data):
        out = learn.walk_forward(frame(spark, data, schema), [2004], models, entity="id", maxIter=5)
        return {r["id"]: r["p"] for r in out.collect()}
    first = run(rows)
    changed = run([(i, s, x, n, 999.0 if s == 2004 else y) for i, s, x, n, y in rows])
    assert first == changed and len(first) == 120
    df = frame(spark, rows, schema)
    model = learn.boosted(df.where("target_season < 2004"), ["x", "noise"], "y", entity="id", maxIter=5)
    drop = {r["feature"]: r["importance"] for r in learn.permutation_importance(
        model, df.where("target_season = 2004"), ["x", "noise"], "y", "id", repeats=4).collect()}
    assert drop["x"] > 0.5 > abs(drop["noise"])


def test_fits_do_not_hang_on_the_input_order(spark, tmp_path, monkeypatch):
    """Rows shuffled over other partitions give the same models; saved ones predict the same."""
    monkeypatch.setattr(learn, "ROWS_PER_PART", 200)
    rng = random.Random(4)
    rows = [(i, s, rng.uniform(0, 1), rng.uniform(0, 1) * 10 ** rng.randrange(-3, 4)) for s in range(2000, 2004) for i in range(150)]
    schema = "id long, target_season long, x double, y double"
    models = {"p": ("y", ["x"])}
    found = []
    for seed, parts in ((1, 3), (2, 7)):
        shuffled = random.Random(seed).sample(rows, len(rows))
        df = frame(spark, shuffled, schema).repartition(parts)
        store = str(tmp_path / f"models-{seed}")
        out = learn.walk_forward(df, [2002, 2003], models, entity="id", store=store, maxIter=8)
        found.append({(r["id"], r["target_season"]): r["p"] for r in out.collect()})
    assert found[0] == found[1] and len(found[0]) == 300
    saved = GBTRegressionModel.load(f"{tmp_path}/models-1/p-2003")
    again = learn.predicted(saved, frame(spark, rows, schema).where("target_season = 2003"), ["x"], "p")
    assert {(r["id"], 2003): r["p"] for r in again.collect()} == {k: v for k, v in found[0].items() if k[1] == 2003}
    trained = {r["target_season"]: r["p"] for r in learn.training_rows(frame(spark, rows, schema), {"p": "y"}).collect()}
    assert trained == {2000: 0, 2001: 150, 2002: 300, 2003: 450}


def test_fits_have_no_indicator_of_what_is_never_missing(spark, tmp_path):
    """A bin that no tree can split on is not summed; the predictions are those with it."""
    rng = random.Random(6)
    rows = [
        (i, s, rng.uniform(0, 1), rng.uniform(0, 1) if i % 4 else None, float(i % 3), rng.uniform(0, 9))
        for s in range(2000, 2003) for i in range(200)
    ]
    df = frame(spark, rows, "id long, target_season long, a double, b double, c double, y double")
    models = {"p": ("y", ["a", "b", "c"]), "q": ("y", ["a", "c"])}
    out = learn.walk_forward(df, [2002], models, entity="id", store=str(tmp_path), maxIter=8)
    p, q = (GBTRegressionModel.load(f"{tmp_path}/{name}-2002") for name in "pq")
    assert (p.numFeatures, q.numFeatures) == (4, 2)
    fold, train = df.where("target_season = 2002"), df.where("target_season < 2002")
    for name, model, features, lacking in (("p", p, ["a", "b", "c"], ["b"]), ("q", q, ["a", "c"], None)):
        whole = learn.boosted(train, features, "y", entity="id", maxIter=8)
        assert whole.numFeatures == 2 * len(features)
        asked = {r["id"]: r[name] for r in out.collect()}
        assert asked == {r["id"]: r["p"] for r in learn.predicted(whole, fold, features, "p").collect()}
        assert asked == {r["id"]: r["p"] for r in learn.predicted(model, fold, features, "p", lacking).collect()}
    with pytest.raises(ValueError):
        learn.predicted(p, fold, ["a", "b", "c"], "p")


def test_fits_of_whole_numbers_read_equal_rows_once(spark, monkeypatch):
    """The predictions are those of a fit on every row; leaves count rows, not cells."""
    rng = random.Random(12)
    rows = []
    for s in range(2000, 2004):
        for i in range(400):
            a, b, c = rng.randrange(12), rng.choice([0, 0, 0, 1, None]), rng.randrange(3)
            rows.append((i, s, float(a), b, c, a * 3 + c * (b or 4) + rng.randrange(4)))
    df = frame(spark, rows, "id long, target_season long, a double, b int, c int, y long")
    fitted = []

    class Watched(learn.GBTRegressor):
        def fit(self, rows):
            fitted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(learn, "GBTRegressor", Watched)
    out = learn.walk_forward(df, [2001, 2003], {"p": ("y", ["a", "b", "c"])}, entity="id", maxIter=20)
    got = {(r["id"], r["target_season"]): r["p"] for r in out.collect()}
    assert len(got) == 800 and len(fitted) == 2 and max(fitted) <= 12 * 3 * 3
    for fold in (2001, 2003):
        whole = learn.boosted(df.where(F.col("target_season") < fold), ["a", "b", "c"], "y", entity="id", maxIter=20)
        for r in learn.predicted(whole, df.where(F.col("target_season") == fold), ["a", "b", "c"], "p").collect():
            assert got[r["id"], fold] == pytest.approx(r["p"], abs=1e-9)
    few = learn.walk_forward(df.where("id < 20"), [2001], {"p": ("y", ["a", "b", "c"])}, entity="id", maxIter=3)
    mean = sum(r[5] for r in rows if r[0] < 20 and r[1] == 2000) / 20
    assert {round(r["p"], 9) for r in few.collect()} == {round(mean, 9)}


def test_few_large_fits_run_at_a_time():
    assert [learn.fits_at_once(parts, 8) for parts in (0, 1, 2, 4, 8, 400)] == [8, 8, 8, 4, 2, 2]


def test_donors_are_drawn_in_many_tasks(spark, monkeypatch):
    """Rows that lie in one stored part are dealt out before their donors are drawn."""
    monkeypatch.setattr(learn, "DRAWS_PER_PART", 50)
    df = frame(spark, [(i, float(i)) for i in range(40)], "id long, x double").coalesce(1)
    drawn = learn.permuted_rows(df, ["x"], "id", 5)
    assert "hashpartitioning(_row#" in (plan := drawn._jdf.queryExecution().executedPlan().toString()) and ", 4), REPARTITION_BY_NUM" in plan
    found = drawn.select("_rep", "_row", "_donor").collect()
    assert {(r[0], r[1]) for r in found} == {(r[0], r[2]) for r in found} == {(k, i) for k in range(1, 6) for i in range(40)}


def test_importance_builds_one_arm(spark, monkeypatch):
    """The frame of the arm without a baseline is not built for the importance of the other."""
    from seasonlake.plans import learned
    from seasonlake.plans.bindings import Tables, forget_gold

    built, gold = [], Tables.gold
    monkeypatch.setattr(Tables, "gold", lambda self, name, build: built.append(name) or gold(self, name, build))
    monkeypatch.setattr(learn, "boosted", lambda *given, **more: None)
    monkeypatch.setattr(learn, "permutation_importance", lambda model, fold, *given: fold)
    forget_gold()
    assert learned.importance(Tables(spark, "/root/testdata/sf0.001")).count() > 0
    assert "learn_old" in built and "learn_new" not in built


@pytest.mark.parametrize("size", [1, 2, 3, 1000, 1023])
def test_shuffled_places_are_a_permutation(spark, size):
    df = spark.range(size).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    got = df.select("seed", "id", learn.shuffled_place(F.col("id"), F.lit(size), F.col("seed")).alias("to")).collect()
    orders = {}
    for r in got:
        orders.setdefault(r["seed"], {})[r["id"]] = r["to"]
    for order in orders.values():
        assert sorted(order.values()) == list(range(size))
    if size == 1000:
        assert orders[1] != orders[2]
        assert sum(i == to for i, to in orders[1].items()) < 12
        near = sum(abs(orders[1][i] - orders[1][i + 1]) < 100 for i in range(999))
        assert 120 < near < 260  # a random order has about 190


def test_folds_come_from_the_data(spark):
    """Any seasons: each one with labels before it is predicted, and none without."""
    rows = [(i, 1900 + y, float(i % 3), None if y == 4 else float(i % 7)) for y in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, target_season int, x double, y double")
    folds = learn.fold_seasons(df, ["y"])
    assert folds == [1901, 1902, 1903, 1904]
    assert learn.fold_seasons(df.where("y IS NULL"), ["y"]) == []
    out = learn.walk_forward(df, folds, {"p": ("y", ["x"])}, entity="id", maxIter=2)
    assert sorted({r.target_season for r in out.collect()}) == folds and out.where("p IS NULL").count() == 0
    assert learn.walk_forward(df, [], {"p": ("y", ["x"])}).count() == 0
    assert not hasattr(learned, "FOLDS") and not hasattr(learned, "ROUNDS")
