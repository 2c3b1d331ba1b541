"""Projection from components: games x team volume x shrunk rates, and its backtest.

Season rows carry entity_id, season, team, games, points, the unit count, the rate
numerators and the per-season bonus total; the roster names the team an entity
starts each season with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions.fixed_values import RATE_GRID, TEAM_GRID
from seasonlake.operators.history import evidence_totals, later_seasons, previous_season
from seasonlake.operators.shrinkage import (
    best_k, games_by_label, incumbency, prior_rates, shrink, transitions, wide_fit,
)


@dataclass(frozen=True)
class Model:
    """What is counted, how it is priced and how far back it looks."""

    rates: dict[str, tuple[str, str]]
    prices: dict[str, float]
    flat_price: float
    unit: str
    bonus: str
    bonus_on: str
    counts: Sequence[str]
    last: int
    first_fold: int
    back: int = 3
    min_games: int = 6
    rate_grid: Sequence[int] = field(default=RATE_GRID)
    team_grid: Sequence[int] = field(default=TEAM_GRID)

    @property
    def volume(self) -> dict[str, tuple[str, str]]:
        return {"team_volume": (self.unit, "games")}


def _team_seasons(seasons: DataFrame, model: Model) -> DataFrame:
    return seasons.groupBy("team", "season").agg(
        F.sum(model.unit).alias(model.unit), F.sum("games").alias("games")
    )


def rate_fit(seasons: DataFrame, model: Model) -> DataFrame:
    """(metric, target_season): prior and k for every rate and for team volume.

    A transition counts only when a full look-back lies behind it.
    """
    last = F.lit(model.last)
    start = seasons.agg((F.min("season") + model.back).alias("s")).scalar()
    qualified = seasons.where(F.col("games") >= model.min_games)
    history = evidence_totals(qualified, ["entity_id"], model.counts, model.back)
    pairs = transitions(
        history, qualified.where(F.col("season") >= start), ["entity_id"], model.rates, model.unit
    )
    fit = best_k(pairs, prior_rates(seasons, model.rates, last), last, model.rate_grid)
    teams = _team_seasons(seasons, model)
    volume = evidence_totals(teams, ["team"], (model.unit, "games"), model.back)
    team_pairs = transitions(
        volume, teams.where(F.col("season") >= start), ["team"], model.volume, None
    )
    team_fit = best_k(team_pairs, prior_rates(seasons, model.volume, last), last, model.team_grid)
    return fit.unionByName(team_fit)


def _expected_games(seasons: DataFrame, labelled: DataFrame, model: Model) -> DataFrame:
    played = labelled.join(seasons.select("entity_id", "season", "games"), ["entity_id", "season"])
    return games_by_label(played, F.lit(model.last))


def _labelled(seasons: DataFrame, roster: DataFrame) -> DataFrame:
    return incumbency(roster, seasons.select("entity_id", "season", "team"))


def project(seasons: DataFrame, roster: DataFrame, model: Model) -> DataFrame:
    """(target_season, entity): components and projected points for every roster row."""
    last = F.lit(model.last)
    labelled = _labelled(seasons, roster)
    expected = _expected_games(seasons, labelled, model)
    qualified = seasons.where(F.col("games") >= model.min_games)
    per_game = F.col(model.bonus) / F.col("games")
    top, bottom = model.rates[model.bonus_on]
    level = F.col(top) / F.col(bottom)
    line = later_seasons(qualified, last, "season", "target_season").groupBy("target_season").agg(
        F.regr_slope(per_game, level).alias("_slope"), F.regr_intercept(per_game, level).alias("_base")
    )
    own = evidence_totals(qualified, ["entity_id"], model.counts, model.back)
    team = evidence_totals(_team_seasons(seasons, model), ["team"], (model.unit, "games"), model.back)
    team = team.select(
        "target_season", "team", F.col(f"w_{model.unit}").alias("_t_units"), F.col("w_games").alias("_t_games")
    )
    df = labelled.withColumnRenamed("season", "target_season")
    df = df.join(wide_fit(rate_fit(seasons, model)), "target_season").join(line, "target_season")
    df = df.join(expected, ["target_season", "incumbency"])
    df = df.join(own, ["target_season", "entity_id"], "left")
    df = df.join(team, ["target_season", "team"], "left")

    def evidence(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)) / 10

    def fitted(metric: str, num: Column, den: Column) -> Column:
        return shrink(num, den, F.col("priors")[metric], F.col("ks")[metric])

    rates = {m: fitted(m, evidence(f"w_{n}"), evidence(f"w_{d}")) for m, (n, d) in model.rates.items()}
    df = df.withColumns(rates).withColumn(
        "team_volume", fitted("team_volume", evidence("_t_units"), evidence("_t_games"))
    )
    each = F.lit(model.flat_price)
    for metric, price in model.prices.items():
        each = each + F.col(metric) * price
    df = df.withColumn(f"expected_{model.unit}", F.col("expected_games") * F.col("team_volume"))
    df = df.withColumn("bonus_per_game", F.col("_slope") * F.col(model.bonus_on) + F.col("_base"))
    points = F.col(f"expected_{model.unit}") * each + F.col("expected_games") * F.col("bonus_per_game")
    kept = [c for c in roster.columns if c not in ("season", "entity_id", "team")]
    return df.withColumn("projected_points", points).select(
        "target_season", "entity_id", "team", *kept, "incumbency", "expected_games",
        f"expected_{model.unit}", "team_volume", *model.rates, "bonus_per_game", "projected_points",
        F.coalesce("seasons_used", F.lit(0).cast("long")).alias("seasons_used"),
    )


def backtest_folds(seasons: DataFrame, roster: DataFrame, model: Model) -> DataFrame:
    """Model and three naive predictions for entities that played the fold season."""
    last = F.lit(model.last)
    said = project(seasons, roster, model).where(F.col("target_season") >= model.first_fold).select(
        F.col("target_season").alias("season"), "entity_id", F.col("projected_points").alias("model")
    )
    qualified = seasons.where(F.col("games") >= model.min_games)
    mean = later_seasons(qualified, last, "season", "_t").groupBy("_t").agg(
        F.avg("points").alias("league_mean")
    ).withColumnRenamed("_t", "season")
    games = _expected_games(seasons, _labelled(seasons, roster), model).groupBy(
        F.col("target_season").alias("season")
    ).agg(F.avg("expected_games").alias("_games"))
    df = said.join(mean, "season").join(games, "season")
    rated = seasons.withColumn("ppg", F.col("points") / F.col("games"))
    df = previous_season(df, rated, ["entity_id"], ["points", "ppg"])
    df = df.join(
        seasons.select("entity_id", "season", F.col("points").alias("actual")), ["entity_id", "season"]
    )
    carried = F.col("ppg_prior") * F.col("_games")
    return df.select(
        F.col("season").alias("target_season"), "entity_id", "actual",
        F.round("model", 6).alias("model"), F.round("league_mean", 6).alias("league_mean"),
        F.round(F.coalesce("points_prior", "league_mean"), 6).alias("prior_points"),
        F.round(F.coalesce(carried, F.col("league_mean")), 6).alias("prior_ppg"),
    )
