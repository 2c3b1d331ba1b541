"""What a side produces and what it allows, per team and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def residual_flag(flags: Sequence[Column]) -> Column:
    """1 unless any flag is set; a NULL flag counts as not set."""
    any_set = F.lit(False)
    for flag in flags:
        any_set = any_set | (F.coalesce(flag.cast("int"), F.lit(0)) == 1)
    return F.when(any_set, 0).otherwise(1)


def inside_flag(inside: Column, start: Column, distance: Column, gain: Column, limit: int = 10) -> Column:
    """1 when flagged inside and the resulting spot is short of ``limit``."""
    spot = start - distance + F.coalesce(gain, F.lit(0))
    return F.when(inside & (spot < limit), 1).otherwise(0)


def unpivot_sides(
    games: DataFrame, keys: Sequence[str], home: str, away: str, home_score: str, away_score: str
) -> DataFrame:
    """Two rows per game, one per team, without scanning the games twice."""
    sides = F.array(
        F.struct(F.col(home).alias("team"), F.col(home_score).alias("points_for"),
                 F.col(away_score).alias("points_against")),
        F.struct(F.col(away).alias("team"), F.col(away_score).alias("points_for"),
                 F.col(home_score).alias("points_against")),
    )
    return games.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")


def per_play_points(base: float, prices: dict[str, float]) -> Column:
    """Aggregate: a flat price plus each flag's rate times its price."""
    total = F.lit(base)
    for flag, price in prices.items():
        total = total + price * F.avg(flag)
    return total


def start_bin(start: Column, edges: Sequence[int], labels: Sequence[str], other: str) -> Column:
    """Label of the first upper edge that holds the value."""
    chain = None
    for edge, label in zip(edges, labels):
        hit = start <= edge
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(other)


def play_cells(plays: DataFrame, keys: Sequence[str], prices: dict[str, float],
               forward_spot: int = 40, deep_spot: int = 20) -> DataFrame:
    """Counts and sums per (keys): teams x opponents x seasons rows, read many times after."""
    spot = F.col("own_yard")
    return plays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("plays"),
        F.sum(spot).alias("own_yard"),
        F.count_if(spot > forward_spot).alias("forward"),
        F.count_if(spot <= deep_spot).alias("deep"),
        F.sum("distance").alias("distance"),
        *[F.sum(flag).alias(flag) for flag in prices],
    )


def _value_of(base: float, prices: dict[str, float]) -> Column:
    total = F.lit(base)
    for flag, price in prices.items():
        total = total + price * (F.sum(flag) / F.sum("plays"))
    return total


def team_environment(
    cells: DataFrame, games: DataFrame, base: float, prices: dict[str, float]
) -> DataFrame:
    """(team, season): own volume, spot, rates and value, and the same allowed.

    ``cells`` comes from :func:`play_cells` with team, opponent and season among
    its keys; ``games`` is the unpivoted calendar, so a team without a play in a
    game still counts it.
    """
    n = F.sum("plays")
    offense = cells.groupBy("team", "season").agg(
        n.alias("plays"),
        (F.sum("own_yard") / n).alias("avg_spot"),
        (F.sum("forward") / n).alias("forward_share"),
        (F.sum("deep") / n).alias("deep_share"),
        (F.sum("distance") / n).alias("gross_average"),
        *[(F.sum(flag) / n).alias(f"{flag}_rate") for flag in prices],
        _value_of(base, prices).alias("points_per_play"),
    )
    defense = cells.groupBy(F.col("opponent").alias("team"), "season").agg(
        n.alias("_forced"),
        (F.sum("own_yard") / n).alias("opp_avg_spot"),
        _value_of(base, prices).alias("opp_points_per_play"),
    )
    calendar = games.groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg("points_for").alias("points_for"),
        F.avg("points_against").alias("points_against"),
    )
    df = offense.join(defense, ["team", "season"]).join(calendar, ["team", "season"])
    return df.withColumns(
        {
            "plays_per_game": F.col("plays") / F.col("games"),
            "play_points_per_game": F.col("plays") / F.col("games") * F.col("points_per_play"),
            "forced_per_game": F.col("_forced") / F.col("games"),
            "points_allowed_per_game": F.col("_forced") / F.col("games") * F.col("opp_points_per_play"),
        }
    ).drop("_forced")
