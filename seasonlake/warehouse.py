"""The derived tables over the domain's own feeds, in build order.

Each function takes the loaded tables by their documented columns and returns one
derived table; ``build`` runs them tier by tier and pins every result, so a later
table reads an earlier one and never rebuilds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions import fixed_values as fixed
from seasonlake.functions.stats import floor_at, mean_of, one_hot, share
from seasonlake.functions.text import canonical_code, name_key, year_of
from seasonlake.operators import (
    asof, blend, component, curve, environment, folds, grades, history, learn, outcomes, rates,
    replacement, value,
)
from seasonlake.operators.ranking import with_rank
from seasonlake.operators.settings import linear_points, with_settings
from seasonlake.session import pinned

SKILL = ("QB", "RB", "WR", "TE")
SLOTS = {"QB": "qb_slots", "RB": "rb_slots", "WR": "wr_slots", "TE": "te_slots"}
FLEX = [("flex_slots", ("RB", "WR", "TE"))]
STARTERS = {"QB": 1, "RB": 1, "WR": 3, "TE": 1}
MIN_GAMES = 6
COMPONENTS = [f"{n}_per_game" for n in fixed.TOTALS] + [*fixed.AVERAGES, "snap_share", "td_regressed_ppg"]


def _played(weekly: DataFrame, positions: Sequence[str] | None = SKILL) -> DataFrame:
    df = weekly.where((F.col("season_type") == "REG") & F.col("fantasy_points_ppr").isNotNull())
    return df.where(F.col("position").isin(*positions)) if positions else df


def _crosswalk_ids(ids: DataFrame) -> DataFrame:
    return ids.withColumn("position", F.when(F.col("position") == "PK", "K").otherwise(F.col("position")))


def line_grades(passing: DataFrame, rushing: DataFrame) -> DataFrame:
    """offensive_line_grades: pressure allowed and yards before contact, graded per season."""
    many = ("2TM", "3TM")
    p = passing.where(~F.col("team").isin(*many) & (F.col("pass_attempts") > 0)).withColumn(
        "team", canonical_code(F.col("team"))
    )
    r = rushing.where(
        ~F.col("tm").isin(*many) & F.col("pos").isin("RB", "FB") & (F.col("att") > 0)
    ).withColumn("team", canonical_code(F.col("tm")))
    keys = ["season", "team"]
    p = grades.group_rate(p, keys, F.col("times_pressured"), F.col("pass_attempts"), "pressure_rate_allowed")
    r = grades.group_rate(r, keys, F.col("ybc"), F.col("att"), "run_block_ybc_per_att")
    return grades.paired_grades(
        p, r, keys, ["season"], "pressure_rate_allowed", "run_block_ybc_per_att",
        "pass_block_grade", "run_block_grade", "ol_grade",
    )


def skill_grades(ngs: DataFrame) -> DataFrame:
    """skill_position_grades: season rows credited to the team of most weekly rows."""
    keys = ["stat_type", "season", "player_gsis_id"]
    weekly = ngs.where(F.col("week").between(1, 18)).withColumnRenamed("team_abbr", "team")
    teams = grades.primary_team(weekly, keys, "team", "week")
    season = ngs.where((F.col("week") == 0) & (F.col("season_type") == "REG")).join(teams, keys)
    season = season.withColumn("team", canonical_code(F.col("team"))).withColumnRenamed("player_position", "position")
    caught = season.where(
        (F.col("stat_type") == "receiving") & F.col("position").isin("WR", "TE") & (F.col("targets") > 0)
    )
    cell = ["season", "team", "position"]
    a = grades.weighted_rate(caught, cell, F.col("avg_separation"), F.col("targets"), "separation").join(
        grades.weighted_rate(caught, cell, F.col("avg_yac_above_expectation"), F.col("receptions"), "yac_over_expected"), cell
    )
    for by, name in (("separation", "_s"), ("yac_over_expected", "_y")):
        a = grades.percentile_grade(a, ["season", "position"], by, name, bounded=True)
    a = a.withColumn("grade", (F.col("_s") + F.col("_y")) / 2).drop("_s", "_y")
    run = season.where((F.col("stat_type") == "rushing") & (F.col("rush_attempts") > 0))
    b = grades.group_rate(
        run, ["season", "team"], F.col("rush_yards_over_expected"), F.col("rush_attempts"), "rush_yards_over_expected_per_att"
    )
    b = grades.percentile_grade(b, ["season"], "rush_yards_over_expected_per_att", "grade", bounded=True)
    return a.unionByName(b.withColumn("position", F.lit("RB")), allowMissingColumns=True)


def weighted_baselines(weekly: DataFrame, snaps: DataFrame, ids: DataFrame) -> DataFrame:
    """player_weighted_baselines: four-season look-back over volume, role and efficiency."""
    w = _played(weekly)
    share_by_season = snaps.where(F.col("game_type") == "REG").join(
        ids.where(F.col("gsis_id").isNotNull()).select(F.col("pfr_id").alias("pfr_player_id"), F.col("gsis_id").alias("player_id")),
        "pfr_player_id",
    ).groupBy("player_id", "season").agg(F.avg("offense_pct").alias("snap_share"))
    scored = {k: (f"{k}_tds", f"{k}_yards") for k in ("receiving", "rushing", "passing")}
    league = rates.rate_with_fallback(w, ["season"], ["position"], {f"{k}_rate": v for k, v in scored.items()}, 5000)
    seasons = w.groupBy("player_id", "season").agg(
        F.min("player_display_name").alias("player_name"), F.min("position").alias("position"),
        F.count(F.lit(1)).alias("games"), F.sum("fantasy_points_ppr").alias("_points"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in fixed.TOTALS.items()], *[F.avg(c).alias(c) for c in fixed.AVERAGES],
    ).where(F.col("games") >= MIN_GAMES)
    seasons = seasons.join(league, ["season", "position"]).join(share_by_season, ["player_id", "season"], "left")
    parts = [
        (6 if k != "passing" else 4, F.col(f"_sum_{k}_tds"), F.col(f"_sum_{k}_yards"), F.col(f"{k}_rate")) for k in scored
    ]
    games = F.col("games")
    seasons = seasons.withColumns(
        {
            "ppg_ppr": F.col("_points") / games,
            "td_regressed_ppg": rates.luck_neutral(F.col("_points"), parts) / games,
            **{f"{n}_per_game": F.col(f"_sum_{n}") / games for n in fixed.TOTALS},
        }
    )
    return history.recency_baseline(
        seasons, ["ppg_ppr", *COMPONENTS], MIN_GAMES, entity="player_id", latest=["player_name", "position"]
    )


def depth_chart(charts: DataFrame, snapshots: DataFrame, schedules: DataFrame) -> DataFrame:
    """player_depth_chart: weekly string numbers and dated ranks under one starter call."""
    coarse = charts.where(
        (F.col("formation") == "Offense") & F.col("position").isin(*SKILL) & (F.col("depth_position") == F.col("position"))
        & F.col("gsis_id").isNotNull() & F.col("depth_team").isNotNull()
    ).select(
        F.col("season").cast("long").alias("season"), F.col("week").cast("long").alias("week"),
        canonical_code(F.col("club_code")).alias("team"), "gsis_id", "position",
        F.col("depth_team").cast("long").alias("string_team"),
    )
    fine = snapshots.where(
        (F.col("pos_grp") == "3WR 1TE") & F.col("pos_abb").isin(*SKILL) & F.col("gsis_id").isNotNull()
    ).select(
        "season", "dt", canonical_code(F.col("team")).alias("team"), "gsis_id", F.col("pos_abb").alias("position"),
        F.col("pos_rank").cast("long").alias("depth_rank"),
    )
    weeks = schedules.where(F.col("game_type") == "REG").groupBy("season", "week").agg(
        F.min(F.col("gameday").try_cast("date")).alias("first_game")
    )
    # snapshots compare by day, and the last stamp of the last day wins
    fine = fine.withColumn("day", F.substring("dt", 1, 10).try_cast("date"))
    newest = fine.groupBy("season", "day").agg(F.max("dt").alias("dt"))
    fine = fine.join(newest, ["season", "day", "dt"], "left_semi")
    return asof.depth_chart(coarse, fine.drop("dt"), weeks, STARTERS, entity="gsis_id", stamp="day")


def adp_consensus(ranked: DataFrame, mocked: DataFrame, ids: DataFrame) -> DataFrame:
    """adp_consensus: a ranked list and one format of a mock-draft list, blended per season."""
    known = _crosswalk_ids(ids).where(F.col("position").isin(*SKILL)).select("gsis_id", "position", "merge_name")
    keys = ["gsis_id", "position", "season"]
    a = blend.crosswalk(ranked.select("name", "position", "season", "adp"), known, name_key(F.col("name")), F.col("merge_name"))
    a = a.groupBy(*keys).agg(F.min("adp").alias("ranked_adp"))
    b = blend.crosswalk(mocked.select("name", "position", "season", "adp", "scoring_format"), known, name_key(F.col("name")), F.col("merge_name"))
    formats = {"mock_adp_standard": "standard", "mock_adp_half_ppr": "half-ppr", "mock_adp_ppr": "ppr"}
    b = b.groupBy(*keys).agg(*[F.max(F.when(F.col("scoring_format") == f, F.col("adp"))).alias(n) for n, f in formats.items()])
    return blend.two_source_blend(a, b, keys, "ranked_adp", "mock_adp_ppr", "consensus_adp")


def _sources(arms: dict[str, DataFrame], *labels: str) -> DataFrame:
    return blend.union_sources({k: v.select("key", "projected_points", *labels) for k, v in arms.items()})


def consensus_projections(feeds: dict[str, DataFrame], ids: DataFrame, inhouse: DataFrame) -> DataFrame:
    """consensus_projections: up to five sources per player.

    ``feeds`` maps a source to rows keyed by a column that the crosswalk knows
    (espn_id, sleeper_id, cbs_id or merge_name), with season, position and points. A feed
    with a week is summed over its weeks; of one with several scorings only ``ppr``
    counts. The in-house arm counts only for the feeds' season.
    """
    known = _crosswalk_ids(ids)
    current = blend.latest_shared_season([f.select("season") for f in feeds.values()])
    kept = (*SKILL, "K")
    arms = {}
    for source, feed in feeds.items():
        key = next(c for c in ("espn_id", "sleeper_id", "cbs_id", "merge_name") if c in feed.columns)
        text = key == "merge_name"
        if "scoring" in feed.columns:
            feed = feed.where(F.col("scoring") == "ppr")
        facts = feed.where(F.col("position").isin(*kept)).select(key, "position", "projected_points").withColumnRenamed(key, "_fact")
        left = F.col("_fact") if text else F.col("_fact").try_cast("double")
        right = known.where(F.col("gsis_id").isNotNull()).select(
            F.col(key).alias("_id"), "position", "gsis_id", F.col("name").alias("player_name")
        )
        joined = blend.crosswalk(facts, right, left, F.col("_id") if text else F.col("_id").cast("double"))
        points = F.sum("projected_points") if "week" in feed.columns else F.max("projected_points")
        arms[source] = joined.groupBy(F.col("gsis_id").alias("key")).agg(
            points.alias("projected_points"), F.min("player_name").alias("player_name"), F.min("position").alias("position")
        )
    own = inhouse.where(F.col("position").isin(*kept)).select(
        F.col("player_id").alias("key"), F.col("target_season").alias("season"),
        F.col("projected_points_full").alias("projected_points"), "player_name", "position",
    )
    arms["inhouse"] = own.join(current, "season", "left_semi")
    labels = [F.min("player_name").alias("player_name"), F.min("position").alias("position")]
    every = _sources(arms, "player_name", "position")
    return blend.consensus(every, ["key"], "projected_points", list(arms), labels).withColumnRenamed("key", "gsis_id")


def team_consensus(feeds: dict[str, DataFrame]) -> DataFrame:
    """consensus_dst_projections: the same per team, keyed by canonical code."""
    arms = {
        s: f.where(F.col("position").isin("DST", "DEF")).groupBy(canonical_code(F.col("team")).alias("key")).agg(
            F.sum("projected_points").alias("projected_points"))
        for s, f in feeds.items()
    }
    return blend.consensus(_sources(arms), ["key"], "projected_points", list(arms)).withColumnRenamed("key", "team")


def over_replacement(weekly: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """points_over_replacement: each league's own scoring, rank, level and difference."""
    stats = [*fixed.STAT_COEFFICIENTS, *fixed.FUMBLE_COLUMNS]
    totals = _played(weekly).groupBy("player_id", "season").agg(
        F.min("player_display_name").alias("player_name"), F.min("position").alias("position"),
        F.count(F.lit(1)).alias("games_played"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in stats],
    )
    prices = [*fixed.STAT_COEFFICIENTS.values(), "fum_lost_pts"]
    pool = with_settings(
        pinned(totals), settings, ["league_key", "team_count", *prices, *SLOTS.values(), *[c for c, _ in FLEX]]
    )
    points = linear_points(fixed.STAT_COEFFICIENTS, fixed.FUMBLE_COLUMNS, "fum_lost_pts")
    pool = pool.withColumn("league_points", points)
    depth = replacement.deepest_rank(settings, SLOTS, FLEX)
    out = replacement.points_over_replacement(pool, ["league_key", "season"], SLOTS, FLEX, depth, entity="player_id")
    return out.select(
        "league_key", "season", "player_id", "player_name", "position", "games_played", "team_count", "league_points",
        "position_rank", "starters_at_position", "replacement_level_points", "points_over_replacement",
    )


PUNT_RATES = {
    "in10_rate": ("in10", "punt_in10_pts"), "in20_rate": ("in20", "punt_in20_pts"),
    "blocked_rate": ("blocked", "punt_blocked_pts"), "returned_rate": ("returned", "punt_returned_pts"),
    "touchback_rate": ("touchbacks", "punt_touchback_pts"), "fair_catch_rate": ("fair_catches", "punt_fair_catch_pts"),
}


def _inside_ten() -> Column:
    return environment.inside_flag(
        F.col("punt_inside_twenty") == 1, F.col("yardline_100"), F.col("kick_distance"), F.col("return_yards")
    )


def punter_seasons(weekly: DataFrame, plays: DataFrame, scoring: dict) -> DataFrame:
    """punter_seasons: points awarded per game, then summed; rates per punt."""
    close = plays.where(F.col("season_type") == "REG").groupBy(
        F.col("punter_player_id").alias("player_id"), "season", "week"
    ).agg(F.sum(_inside_ten()).alias("_in10"))
    w = weekly.where((F.col("season_type") == "REG") & (F.col("pt_att") > 0)).join(close, ["player_id", "season", "week"], "left")
    average = F.col("pt_yards") / F.col("pt_att")
    bonus = (
        F.when(average >= 44, scoring["punt_avg44_pts"]).when(average >= 42, scoring["punt_avg42_pts"])
        .when(average >= 40, scoring["punt_avg40_pts"]).otherwise(0.0)
    )
    w = w.select(
        F.col("player_id").alias("entity_id"), "player_display_name", "season", "week", "team",
        F.col("pt_att").alias("punts"), F.col("pt_yards").alias("punt_yards"), F.col("pt_net_yards").alias("net_yards"),
        F.col("pt_inside_20").alias("in20"), F.least(F.coalesce("_in10", F.lit(0)), "pt_inside_20").alias("in10"),
        F.col("pt_blocked").alias("blocked"), F.col("pt_returned").alias("returned"),
        F.col("pt_touchback").alias("touchbacks"), F.col("pt_fair_caught").alias("fair_catches"), bonus.alias("bonus"),
    )
    points = F.col("punts") * scoring["punt_pts"] + F.col("bonus")
    for numerator, price in PUNT_RATES.values():
        points = points + F.col(numerator) * scoring[price]
    sums = ("punts", "punt_yards", "net_yards", "in10", "in20", "blocked", "returned", "touchbacks", "fair_catches", "bonus")
    df = w.withColumn("points", points).groupBy("entity_id", "season").agg(
        F.min("player_display_name").alias("player_name"), F.mode("team", deterministic=True).alias("team"),
        F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"), *[F.sum(c).alias(c) for c in sums],
    )
    per = F.col("punts")
    return df.withColumns(
        {
            "points_per_game": F.col("points") / F.col("games"), "punts_per_game": per / F.col("games"),
            "gross_average": F.col("punt_yards") / per, "net_average": F.col("net_yards") / per,
            **{rate: F.col(n) / per for rate, (n, _) in PUNT_RATES.items()},
        }
    )


def punter_model(scoring: dict, upcoming: int, first_fold: int = 2019) -> component.Model:
    numerators = [n for n, _ in PUNT_RATES.values()]
    return component.Model(
        rates={**{r: (n, "punts") for r, (n, _) in PUNT_RATES.items()}, "gross_average": ("punt_yards", "punts")},
        prices={r: float(scoring[p]) for r, (_, p) in PUNT_RATES.items()}, flat_price=float(scoring["punt_pts"]),
        unit="punts", bonus="bonus", bonus_on="gross_average", counts=("punts", "punt_yards", *numerators, "games"),
        last=upcoming, first_fold=first_fold,
    )


def punter_roster(rosters: DataFrame) -> DataFrame:
    """Team of the earliest listed week per season."""
    active = rosters.where((F.col("position") == "P") & (F.col("status") == "ACT") & F.col("player_id").isNotNull())
    first = F.min_by(F.struct("player_name", "team", "years_exp", "age"), F.struct("week", "team")).alias("r")
    return active.groupBy(F.col("player_id").alias("entity_id"), "season").agg(first).select("entity_id", "season", "r.*")


def punter_projections(seasons: DataFrame, roster: DataFrame, model: component.Model, outside: DataFrame) -> DataFrame:
    """punter_projections: the upcoming season, beside an outside feed where 0.0 means absent."""
    df = component.project(seasons, roster, model).where(F.col("target_season") == model.last)
    feed = outside.select("entity_id", F.nullif("projected_points", F.lit(0.0)).alias("projected_points_outside"))
    df = df.join(feed, "entity_id", "left")
    both = mean_of([F.col("projected_points"), F.col("projected_points_outside")])
    return df.withColumn("projected_points_blended", both)


def punter_backtest(seasons: DataFrame, roster: DataFrame, model: component.Model) -> DataFrame:
    """punter_backtest: the model and three naive predictions, fold by fold."""
    made = pinned(component.backtest_folds(seasons, roster.select("entity_id", "season", "team"), model))
    names = {p: p for p in ("model", "prior_points", "prior_ppg", "league_mean")}
    long = folds.stack_predictions(made, ["target_season", "entity_id", "actual"], names)
    return folds.fold_metrics(long, ["target_season", "prediction"], "actual", "predicted", "entity_id")


def punt_environment(plays: DataFrame, schedules: DataFrame, scoring: dict) -> DataFrame:
    """punt_environment: what a team's punts are worth and what it allows."""
    zero = F.lit(0)
    shown = [F.col(c) == 1 for c in (
        "punt_fair_catch", "touchback", "punt_downed", "punt_out_of_bounds", "punt_blocked", "punt_in_endzone")]
    p = plays.where(
        (F.col("season_type") == "REG") & F.col("yardline_100").isNotNull() & F.col("kick_distance").isNotNull()
    ).select(
        F.col("posteam").alias("team"), F.col("defteam").alias("opponent"), "season",
        (100 - F.col("yardline_100")).alias("own_yard"), F.col("kick_distance").alias("distance"), _inside_ten().alias("in10"),
        F.coalesce("punt_inside_twenty", zero).alias("in20"), F.coalesce("touchback", zero).alias("touchback"),
        F.coalesce("punt_fair_catch", zero).alias("fair_catch"), F.coalesce("punt_blocked", zero).alias("blocked"),
        environment.residual_flag(shown).alias("returned"),
    )
    prices = {f: float(scoring[f"punt_{f}_pts"]) for f in ("in10", "in20", "touchback", "fair_catch", "blocked", "returned")}
    cells = pinned(environment.play_cells(p, ["team", "opponent", "season"], prices))
    games = environment.unpivot_sides(
        schedules.where(F.col("game_type") == "REG"), ["season"], "home_team", "away_team", "home_score", "away_score"
    )
    return environment.team_environment(cells, games, float(scoring["punt_pts"]), prices)


def _prices(adp: DataFrame) -> DataFrame:
    return adp.where(F.col("consensus_adp").isNotNull()).select(
        F.col("gsis_id").alias("player_id"), "season", "position", F.col("consensus_adp").alias("price")
    )


def boom_bust(por: DataFrame, adp: DataFrame, chart: DataFrame, weekly: DataFrame) -> DataFrame:
    """boom_bust: tiers, percentiles and nine outcome buckets against the price."""
    role = outcomes.played_role(chart.withColumnRenamed("gsis_id", "player_id"), _played(weekly, None), entity="player_id")
    return outcomes.outcome_buckets(por, outcomes.price_ranks(_prices(adp)), role, entity="player_id")


def breakout_candidates(projected: DataFrame, adp: DataFrame) -> DataFrame:
    """breakout_candidates: predicted percentile against the market's; NULL when unpriced."""
    market = with_rank(_prices(adp), ["season", "position"], "price", percent_rank_desc="preseason_percentile")
    market = market.withColumnRenamed("season", "target_season").withColumnRenamed("price", "consensus_adp")
    said = projected.where(F.col("projected_points").isNotNull()).select("target_season", "player_id", "position", "projected_points")
    said = with_rank(said, ["target_season", "position"], "projected_points", pin=True, percent_rank="predicted_percentile")
    out = said.join(market, ["target_season", "player_id", "position"], "left")
    return out.withColumn("predicted_delta", F.col("predicted_percentile") - F.col("preseason_percentile"))


def draftable_board(adp: DataFrame, por: DataFrame, weekly: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """Priced players x leagues for played seasons: unplayed is zero, unresolved is dropped."""
    played = _played(weekly, None)
    last = weekly.agg(F.max("season").alias("m")).scalar()
    asked = _prices(adp).where(F.col("position").isin(*SKILL) & (F.col("season") <= last))
    asked = asked.join(played.select("player_id").distinct(), "player_id", "left_semi")
    points = por.select("league_key", "season", "player_id", "league_points")
    out = with_settings(asked, settings, ["league_key"]).join(points, ["league_key", "season", "player_id"], "left")
    return out.withColumn("never_played", F.col("league_points").isNull()).withColumn(
        "league_points", F.coalesce("league_points", F.lit(0.0))
    )


def draft_value(
    adp: DataFrame, por: DataFrame, weekly: DataFrame, projected: DataFrame, settings: Sequence[dict]
) -> DataFrame:
    """draft_value: surplus over the walk-forward price curve, realised and projected."""
    cell = ["league_key", "season", "position"]
    levels = por.groupBy(*cell).agg(F.max("replacement_level_points").alias("_level"))
    actual = F.col("league_points") - F.col("_level")
    board = draftable_board(adp, por, weekly, settings).join(levels, cell, "left")
    board = board.withColumn("actual_por", actual).withColumn("actual_value", floor_at(actual, 0.0)).drop("_level", "league_points")
    board = pinned(board)
    newest = adp.agg(F.max("season").alias("m")).scalar()
    last = weekly.agg(F.max("season").alias("m")).scalar()
    live = _prices(adp).where(F.col("position").isin(*SKILL) & (F.col("season") == newest) & (F.col("season") > last))
    live = with_settings(live, settings, ["league_key"]).withColumn("never_played", F.lit(False))
    curves = curve.walk_forward_curve(board, ["league_key", "position"], "price", "actual_value", newest)
    ppr = _played(weekly).groupBy("player_id", "season").agg(F.sum("fantasy_points_ppr").alias("ppr_points"))
    scale = curve.origin_scale(por.join(ppr, ["player_id", "season"]), ["league_key", "position"], "ppr_points", "league_points")
    said = projected.where(F.col("projected_points").isNotNull() & F.col("position").isin(*SKILL)).select(
        F.col("target_season").alias("season"), "player_id", "position", "projected_points"
    )
    pool = with_settings(said, settings, ["league_key", "team_count", *SLOTS.values(), *[c for c, _ in FLEX]])
    pool = pinned(pool.join(scale, ["league_key", "position"]).withColumn("league_points", F.col("projected_points") * F.col("scale")))
    depth = replacement.deepest_rank(settings, SLOTS, FLEX)
    bars = replacement.replacement_levels(pool, ["league_key", "season"], SLOTS, FLEX, depth, entity="player_id")
    over = F.col("league_points") - F.col("replacement_level_points")
    ahead = pool.join(bars, cell).select(
        "league_key", "season", "player_id", over.alias("projected_por"), floor_at(over, 0.0).alias("projected_value")
    )
    both = board.unionByName(live, allowMissingColumns=True)
    return value.surplus_table(both, curves, ahead, "price", entity="player_id")


def archetypes(
    buckets: DataFrame, adp: DataFrame, players: DataFrame, surplus: DataFrame, settings: Sequence[dict], reference: str
) -> DataFrame:
    """player_archetypes: class of every priced row and the edge earlier seasons support."""
    last = buckets.agg(F.max("season").alias("m")).scalar()
    live = with_settings(_prices(adp).where(F.col("position").isin(*SKILL) & (F.col("season") > last)), settings, ["league_key"])
    rows = buckets.select("league_key", "season", "player_id", "position", "price", "outcome_bucket", "is_elite_finish")
    rows = rows.unionByName(live, allowMissingColumns=True)
    rows = history.prior_counters(rows, ["league_key", "player_id"], F.col("is_elite_finish")).where(F.col("price").isNotNull())
    facts = players.select(F.col("gsis_id").alias("player_id"), "rookie_season", year_of(F.col("birth_date")).alias("_born"))
    keys = ["league_key", "season", "player_id"]
    rows = rows.join(facts, "player_id", "left").join(
        surplus.select(*keys, "surplus_centered", "projected_surplus", "expected_value", "actual_value"), keys, "left"
    )
    rows = rows.withColumn("seasons_of_experience", F.col("season") - F.col("rookie_season")).withColumn(
        "age_at_season", F.col("season") - F.col("_born")
    ).drop("_born")
    cell = outcomes.archetype(F.col("prior_elite"), F.col("age_at_season"), F.col("seasons_of_experience"))
    rows = rows.withColumn("archetype", cell).where(F.col("archetype").isNotNull())
    return outcomes.walk_forward_edge(pinned(rows), reference)


def model_frames(
    base: DataFrame, weekly: DataFrame, rosters: DataFrame, chart: DataFrame, players: DataFrame,
    lines: DataFrame, skills: DataFrame, adp: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the two arms: with a baseline, and listed in week 1 without one."""
    played = _played(weekly)
    newest = weekly.agg(F.max("season").alias("m")).scalar()
    games = played.groupBy("player_id", "season").agg(
        F.count(F.lit(1)).alias("_games"), (F.sum("fantasy_points_ppr") / F.count(F.lit(1))).alias("_ppg")
    )
    label = games.select(
        "player_id", F.col("season").alias("target_season"), F.when(F.col("_games") >= MIN_GAMES, F.col("_ppg")).alias("actual_ppg_ppr")
    )
    listed = chart.where(F.col("week") == 1).groupBy(F.col("gsis_id").alias("player_id"), F.col("season").alias("target_season")).agg(
        F.min("team").alias("_listed"), F.max(F.coalesce(F.col("is_starter"), F.lit(False)).cast("int")).alias("_starts")
    )
    role = chart.groupBy(F.col("gsis_id").alias("player_id"), (F.col("season") + 1).alias("target_season")).agg(
        F.count(F.lit(1)).alias("weeks_on_depth_chart"), share(F.col("is_starter")).alias("starter_share"),
        F.max_by("is_starter", "week").cast("long").alias("end_starter"),
    )
    seen = weekly.where(F.col("season_type") == "REG").withColumn("team", canonical_code(F.col("team")))
    team = grades.primary_team(seen, ["player_id", "season"], "team", "week").select(
        "player_id", (F.col("season") + 1).alias("target_season"), F.col("team").alias("_last_team")
    )
    people = players.select(F.col("gsis_id").alias("player_id"), "rookie_season", "draft_pick", year_of(F.col("birth_date")).alias("_born"))
    market = adp.select(F.col("gsis_id").alias("player_id"), F.col("season").alias("target_season"), "consensus_adp")
    ol = lines.select(F.col("team").alias("context_team"), (F.col("season") + 1).alias("target_season"), "ol_grade")
    sk = skills.select(
        F.col("team").alias("context_team"), (F.col("season") + 1).alias("target_season"), "position", F.col("grade").alias("skill_grade")
    )
    key = ["player_id", "target_season"]

    def context(df: DataFrame) -> DataFrame:
        df = df.join(ol, ["context_team", "target_season"], "left").join(sk, ["context_team", "target_season", "position"], "left")
        df = df.join(people, "player_id", "left").join(market, key, "left").join(label, key, "left")
        df = df.withColumn("age_at_season", F.col("target_season") - F.col("_born")).drop("_born")
        return df.select("*", *one_hot(F.col("position"), SKILL, "position"))

    a = base.join(team, key, "left").join(listed, key, "left").join(role, key, "left")
    a = a.withColumns(
        {
            "context_team": F.coalesce("_listed", "_last_team"), "target_is_starter": F.coalesce("_starts", F.lit(0)),
            "changed_team": (F.col("_listed") != F.col("_last_team")).cast("long"),
        }
    )
    a = context(a).withColumn("seasons_of_experience", F.col("target_season") - F.col("rookie_season"))
    members = rosters.where(F.col("position").isin(*SKILL) & (F.col("season") <= newest)).select("player_id", "season").distinct()
    volume = members.join(games.select("player_id", "season", "_games"), ["player_id", "season"], "full").select(
        "player_id", F.col("season").alias("target_season"), F.coalesce("_games", F.lit(0)).alias("actual_games")
    )
    a = a.join(volume, key, "left")

    facts = rosters.where(F.col("position").isin(*SKILL)).groupBy("player_id", F.col("season").alias("target_season")).agg(
        F.min("draft_number").alias("draft_number"), F.min("years_exp").alias("seasons_of_experience"),
        F.min("player_name").alias("player_name"), F.min("position").alias("position"),
    )
    # totals before each roster season: box scores and roster rows share one ordered history
    sums = played.groupBy("player_id", F.col("season").alias("target_season")).agg(
        F.sum("fantasy_points_ppr").alias("_p"), F.count(F.lit(1)).alias("_g")
    )
    earlier = history.before_season(["player_id"], "target_season")
    career = facts.select(*key).join(sums, key, "full").select(
        *key, (F.sum("_p").over(earlier) / F.sum("_g").over(earlier)).alias("career_ppg"), F.sum("_g").over(earlier).alias("career_games")
    )
    b = facts.join(listed, key).join(base.select(*key), key, "left_anti").join(career, key, "left")
    b = context(b.withColumnRenamed("_listed", "context_team").withColumnRenamed("_starts", "target_is_starter"))
    b = b.join(games.select("player_id", F.col("season").alias("target_season"), "_games"), key, "left")
    b = b.withColumn("actual_games", F.when(F.col("target_season") <= newest, F.coalesce("_games", F.lit(0)))).drop("_games")
    return pinned(a), pinned(b)


_DUMMIES = [f"position_{p}" for p in SKILL]
RATE_FEATURES = [*fixed.RATE_INPUTS, *[f"weighted_{c}" for c in COMPONENTS], *_DUMMIES]
GAMES_FEATURES = [*fixed.GAMES_INPUTS, *_DUMMIES]
NEW_RATE_FEATURES = [*fixed.NEW_RATE_INPUTS, *_DUMMIES]
NEW_GAMES_FEATURES = [*fixed.NEW_GAMES_INPUTS, *_DUMMIES]


def season_lengths(schedules: DataFrame) -> DataFrame:
    """Games per scheduled season."""
    return schedules.where(F.col("game_type") == "REG").groupBy("season").agg(
        F.round(F.count(F.lit(1)) * 2.0 / F.countDistinct("home_team")).cast("long").alias("season_games")
    )


def inhouse_projections(
    arms: tuple[DataFrame, DataFrame], schedules: DataFrame, fold_seasons: Sequence[int], live: int, **params
) -> DataFrame:
    """inhouse_projections: walk-forward folds and the live season of both arms.

    Live rows of the first arm need a known team. The live fold trains on every
    earlier season, which is the same rule.
    """
    a, b = arms
    seasons = sorted({*fold_seasons, live})
    a = a.where((F.col("target_season") != live) | F.col("context_team").isNotNull())
    one = learn.walk_forward(
        a, seasons, {"predicted_ppg_ppr": ("actual_ppg_ppr", RATE_FEATURES), "expected_games": ("actual_games", GAMES_FEATURES)}, entity="player_id", **params
    )
    two = learn.walk_forward(
        b, seasons, {"predicted_ppg_ppr": ("actual_ppg_ppr", NEW_RATE_FEATURES), "expected_games": ("actual_games", NEW_GAMES_FEATURES)}, entity="player_id", **params
    )
    keep = ["player_id", "target_season", "position", "player_name", "target_is_starter", "consensus_adp", "actual_ppg_ppr",
            "actual_games", "predicted_ppg_ppr", "expected_games"]
    both = one.select(*keep, "weighted_ppg_ppr", "weighted_games_per_season", F.lit("baseline").alias("arm")).unionByName(
        two.select(*keep, F.lit("no_baseline").alias("arm")), allowMissingColumns=True
    )
    both = learn.residual_intervals(pinned(both), "actual_ppg_ppr", "predicted_ppg_ppr", "player_id")
    lengths = season_lengths(schedules)
    newest = lengths.agg(F.max_by("season_games", "season").alias("g")).scalar()
    both = both.join(lengths.withColumnRenamed("season", "target_season"), "target_season", "left")
    both = both.withColumn("season_games", F.coalesce("season_games", newest))
    both = learn.role_games(both, "expected_games", "target_is_starter", "season_games", ["target_season", "position"])
    return learn.season_totals(both, "predicted_ppg_ppr", "expected_games")


def inhouse_backtest(projected: DataFrame, min_rows: int = 20) -> DataFrame:
    """inhouse_backtest: model, carry-forward and market, per fold and position and pooled.

    Players without a baseline have a row of their own against the position's mean in the
    training slice; the pooled row also says how far games were off. The market is scored on priced rows only, and the model once more on the same rows.
    """
    columns = ["target_season", "position", "player_id", "actual_ppg_ppr", "predicted_ppg_ppr", "weighted_ppg_ppr", "consensus_adp"]
    rated = projected.where(F.col("actual_ppg_ppr").isNotNull())
    scored = pinned(rated.where(F.col("arm") == "baseline").select(*columns))
    new = projected.where(F.col("arm") == "no_baseline")
    means = history.slice_means(new, ["position"], "actual_ppg_ppr", "weighted_ppg_ppr", "target_season")
    fresh = rated.where(F.col("arm") == "no_baseline").drop("weighted_ppg_ppr").join(means, ["position", "target_season"])
    veterans = projected.where(F.col("arm") == "baseline")
    availability = folds.games_metrics(veterans, ["target_season"], "actual_games", "expected_games", "weighted_games_per_season")
    return folds.backtest_table(
        scored, fresh.select(*columns), availability, ["target_season"], "position", "actual_ppg_ppr", "predicted_ppg_ppr",
        "weighted_ppg_ppr", "consensus_adp", "player_id", min_rows,
    )


def build(
    silver: dict[str, DataFrame],
    settings: Sequence[dict],
    reference: str,
    punt_league: str,
    upcoming: int,
    fold_seasons: Sequence[int],
    feeds: dict[str, DataFrame],
    team_feeds: dict[str, DataFrame],
    outside_punters: DataFrame,
    punt_first_fold: int = 2019,
    **boosting,
) -> dict[str, DataFrame]:
    """Every derived table in dependency order, each pinned before the next reads it."""
    s = silver
    gold: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        gold[name] = pinned(df)
        return gold[name]

    weekly = s["weekly_stats"]
    scoring = next(row for row in settings if row["league_key"] == punt_league)
    lines = keep("offensive_line_grades", line_grades(s["pfr_advstats_pass"], s["pfr_advstats_rush"]))
    skills = keep("skill_position_grades", skill_grades(s["ngs_data"]))
    base = keep("player_weighted_baselines", weighted_baselines(weekly, s["snap_counts"], s["ids"]))
    chart = keep("player_depth_chart", depth_chart(s["depth_charts"], s["depth_chart_snapshots"], s["schedules"]))
    adp = keep("adp_consensus", adp_consensus(s["ranked_adp"], s["mock_adp"], s["ids"]))

    arms = model_frames(base, weekly, s["rosters"], chart, s["players"], lines, skills, adp)
    projected = keep("inhouse_projections", inhouse_projections(arms, s["schedules"], fold_seasons, upcoming, **boosting))
    keep("inhouse_backtest", inhouse_backtest(projected))
    por = keep("points_over_replacement", over_replacement(weekly, settings))
    punts = keep("punter_seasons", punter_seasons(weekly, s["pbp_punts"], scoring))
    model = punter_model(scoring, upcoming, punt_first_fold)
    roster = pinned(punter_roster(s["rosters"]))
    keep("punter_projections", punter_projections(punts, roster, model, outside_punters))
    keep("punter_backtest", punter_backtest(punts, roster, model))
    keep("punt_environment", punt_environment(s["pbp_punts"], s["schedules"], scoring))

    keep("consensus_projections", consensus_projections(feeds, s["ids"], projected))
    keep("consensus_dst_projections", team_consensus(team_feeds))
    buckets = keep("boom_bust", boom_bust(por, adp, chart, weekly))
    keep("breakout_candidates", breakout_candidates(projected, adp))
    surplus = keep("draft_value", draft_value(adp, por, weekly, projected, settings))
    classes = keep("player_archetypes", archetypes(buckets, adp, s["players"], surplus, settings, reference))
    keep("archetype_outcomes", outcomes.archetype_outcomes(classes, reference))
    return gold
