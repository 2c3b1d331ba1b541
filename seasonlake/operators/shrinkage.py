"""Shrunk rates: evidence totals, prior means and the shrinkage strength that predicts best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions.fixed_values import RATE_GRID
from seasonlake.operators.history import later_seasons, previous_season

INCUMBENT, NEW_TEAM, UNPROVEN = "incumbent", "new_team", "unproven"


def shrink(numerator: Column, denominator: Column, prior: Column, k: Column) -> Column:
    """Observed evidence pulled toward ``prior`` by ``k`` units of it."""
    return (numerator + k * prior) / (denominator + k)


def prior_rates(
    seasons: DataFrame, rates: dict[str, tuple[str, str]], last: Column, season: str = "season"
) -> DataFrame:
    """(metric, target): ratio of sums over every earlier season."""
    columns = sorted({c for pair in rates.values() for c in pair})
    sums = seasons.groupBy(season).agg(*[F.sum(c).alias(c) for c in columns])
    sums = later_seasons(sums, last, season, "target_season")
    sums = sums.groupBy("target_season").agg(*[F.sum(c).alias(c) for c in columns])
    stacked = ", ".join(f"'{m}', {n} / nullif({d}, 0)" for m, (n, d) in rates.items())
    return sums.selectExpr("target_season", f"stack({len(rates)}, {stacked}) AS (metric, prior)")


def transitions(
    history: DataFrame,
    current: DataFrame,
    key: Sequence[str],
    rates: dict[str, tuple[str, str]],
    weight: str | None,
) -> DataFrame:
    """(metric, season, num, den, actual, weight): history up to S-1 beside season S."""
    now = current.select(
        *key, F.col("season"),
        *[F.col(c).alias(f"now_{c}") for c in sorted({c for p in rates.values() for c in p})],
        (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight"),
    )
    both = history.withColumnRenamed("target_season", "season").join(now, [*key, "season"])
    stacked = ", ".join(
        f"'{m}', CAST(w_{n} AS DOUBLE) / 10, CAST(w_{d} AS DOUBLE) / 10, now_{n} / now_{d}"
        for m, (n, d) in rates.items()
    )
    return both.selectExpr(
        "season", "weight", f"stack({len(rates)}, {stacked}) AS (metric, num, den, actual)"
    )


def best_k(
    pairs: DataFrame,
    priors: DataFrame,
    last: Column,
    grid: Sequence[int] = RATE_GRID,
    min_rows: int = 20,
) -> DataFrame:
    """(metric, target_season): the k with the least weighted squared error.

    With a = num/(den+k) and b = k/(den+k) the error is quadratic in the prior,
    w(a - y)^2 + 2 p w b (a - y) + p^2 w b^2, so one pass keeps three sums per k and
    season; every fold is then a sum over a table of seasons. The first best wins
    ties; a fold with too few transitions takes the middle of the grid.
    """
    w, y = F.col("weight"), F.col("actual")
    made = [F.count(F.lit(1)).alias("rows"), F.sum(w).alias("w")]
    for k in grid:
        a = F.col("num") / (F.col("den") + k)
        b = F.lit(float(k)) / (F.col("den") + k)
        made += [
            F.sum(w * (a - y) * (a - y)).alias(f"a{k}"),
            F.sum(w * b * (a - y)).alias(f"b{k}"),
            F.sum(w * b * b).alias(f"c{k}"),
        ]
    sums = pairs.groupBy("metric", "season").agg(*made)
    names = [c for c in sums.columns if c not in ("metric", "season")]
    sums = later_seasons(sums, last, "season", "target_season")
    sums = sums.groupBy("metric", "target_season").agg(*[F.sum(c).alias(c) for c in names])
    fitted = priors.join(sums, ["metric", "target_season"], "left")
    p = F.col("prior")
    errors = [
        F.struct(
            ((F.col(f"a{k}") + 2 * p * F.col(f"b{k}") + p * p * F.col(f"c{k}")) / F.col("w")).alias("e"),
            F.lit(int(k)).alias("k"),
        )
        for k in grid
    ]
    chosen = F.when(F.col("rows") >= min_rows, F.array_min(F.array(*errors))["k"])
    middle = F.lit(int(grid[len(grid) // 2]))
    return fitted.select("metric", "target_season", "prior", F.coalesce(chosen, middle).alias("k"))


def incumbency(
    roster: DataFrame, seasons: DataFrame, entity: str = "entity_id", team: str = "team"
) -> DataFrame:
    """Label each (entity, season) of a roster by last season's team."""
    out = previous_season(roster, seasons, [entity], [team])
    before = F.col(f"{team}_prior")
    label = (
        F.when(before.isNull(), UNPROVEN).when(before == F.col(team), INCUMBENT).otherwise(NEW_TEAM)
    )
    return out.withColumn("incumbency", label).drop(f"{team}_prior")


def games_by_label(labelled: DataFrame, last: Column, games: str = "games") -> DataFrame:
    """(target_season, incumbency): mean games of earlier seasons, pooled mean as fallback."""
    sums = labelled.where(F.col(games).isNotNull()).groupBy("season", "incumbency").agg(
        F.sum(games).alias("s"), F.count(F.lit(1)).alias("n")
    )
    sums = later_seasons(sums, last, "season", "target_season")
    by_label = sums.groupBy("target_season", "incumbency").agg(
        (F.sum("s") / F.sum("n")).alias("expected_games")
    )
    pooled = sums.groupBy("target_season").agg((F.sum("s") / F.sum("n")).alias("_pooled"))
    labels = F.array(F.lit(INCUMBENT), F.lit(NEW_TEAM), F.lit(UNPROVEN))
    grid = pooled.withColumn("incumbency", F.explode(labels))
    out = grid.join(by_label, ["target_season", "incumbency"], "left")
    return out.select(
        "target_season", "incumbency",
        F.coalesce("expected_games", "_pooled").alias("expected_games"),
    )


def wide_fit(fit: DataFrame) -> DataFrame:
    """(target_season): priors and strengths as two small maps keyed by metric."""
    return fit.groupBy("target_season").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "prior"))).alias("priors"),
        F.map_from_entries(F.collect_list(F.struct("metric", "k"))).alias("ks"),
    )

