"""Look-back history: recency-weighted baselines, career counters, year-over-year pairs.

Every function here works on (entity, season) rows, so one entity never holds
more rows than there are seasons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from seasonlake.functions.fixed_values import RECENCY_TENTHS
from seasonlake.functions.stats import correlation, recency_tenths, weighted_mean


def look_back(
    df: DataFrame, back: int, season: str = "season", target: str = "target_season"
) -> DataFrame:
    """Range join ``season < target <= season + back`` written as a row generator.

    Targets run to one past the newest season. No join is needed: each fact row
    names the targets it belongs to.
    """
    newest = df.agg(F.max(season).alias("m")).scalar()
    last = F.least(F.col(season) + back, newest + 1)
    return df.withColumn(target, F.explode(F.sequence(F.col(season) + 1, last)))


def later_seasons(df: DataFrame, last: Column, season: str, target: str) -> DataFrame:
    """Every row once per season after its own, up to ``last``."""
    known = df.withColumn("_last", last).where(F.col(season) < F.col("_last"))
    span = F.sequence(F.col(season) + 1, F.col("_last"))
    return known.withColumn(target, F.explode(span)).drop("_last")


def recency_baseline(
    seasons: DataFrame,
    values: Sequence[str],
    min_games: int = 6,
    back: int = 4,
    tenths: dict[int, int] = RECENCY_TENTHS,
    entity: str = "entity_id",
    games: str = "games",
    latest: Sequence[str] = (),
    prefix: str = "weighted_",
) -> DataFrame:
    """(target_season, entity): seasons and games used, recency-weighted means.

    A season below ``min_games`` is not history at all. A value missing in one
    season drops out of its own numerator and denominator only. ``latest`` names
    attributes taken from the newest season used.
    """
    history = look_back(seasons.where(F.col(games) >= min_games), back)
    weight = recency_tenths(F.col("target_season") - F.col("season"), tenths)
    history = history.withColumn("_w", weight)
    return history.groupBy("target_season", entity).agg(
        *[F.max_by(c, "season").alias(c) for c in latest],
        F.count(F.lit(1)).alias("seasons_used"),
        F.sum(games).cast("long").alias("games_used"),
        *[weighted_mean(F.col(v), F.col("_w")).alias(f"{prefix}{v}") for v in values],
        weighted_mean(F.col(games), F.col("_w")).alias(f"{prefix}games_per_season"),
    )


def evidence_totals(
    seasons: DataFrame,
    key: Sequence[str],
    counts: Sequence[str],
    back: int = 3,
    tenths: dict[int, int] = RECENCY_TENTHS,
) -> DataFrame:
    """(target_season, key): recency-weighted totals in tenths, and seasons used.

    Totals, not means: shrinkage needs to know how much evidence stands behind a rate.
    """
    history = look_back(seasons, back)
    weight = recency_tenths(F.col("target_season") - F.col("season"), tenths)
    history = history.withColumn("_w", weight)
    return history.groupBy("target_season", *key).agg(
        *[F.sum(F.col(c) * F.col("_w")).alias(f"w_{c}") for c in counts],
        F.count(F.lit(1)).alias("seasons_used"),
    )


def before_season(entity: Sequence[str], season: str = "season") -> W:
    """All earlier seasons of an entity, the current one excluded."""
    return W.partitionBy(*entity).orderBy(season).rangeBetween(W.unboundedPreceding, -1)


def slice_means(df: DataFrame, group: Sequence[str], value: str, name: str, season: str = "season") -> DataFrame:
    """(group, season, name): mean of all known values of earlier seasons.

    What a group's training slice says; a group without earlier values takes the mean of
    all groups', and the first season has none. Rows shrink to (group, season) sums
    before a window over the seasons adds them up.
    """
    keys = list(group)
    sums = df.groupBy(*keys, season).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    every = sums.groupBy(season).agg(F.sum("_s").alias("_as"), F.sum("_n").alias("_an"))

    def earlier_mean(total: str, count: str, over: W) -> Column:
        return F.sum(total).over(over) / F.nullif(F.sum(count).over(over), F.lit(0))

    every = every.select(season, earlier_mean("_as", "_an", before_season([], season)).alias("_all"))
    own = sums.select(*keys, season, earlier_mean("_s", "_n", before_season(keys, season)).alias("_own"))
    return own.join(every, season).select(*keys, season, F.coalesce("_own", "_all").alias(name))


def prior_counters(
    df: DataFrame, entity: Sequence[str], flag: Column, season: str = "season"
) -> DataFrame:
    """Earlier seasons, earlier flagged seasons, and whether last season was flagged."""
    earlier = before_season(entity, season)
    last = W.partitionBy(*entity).orderBy(season).rangeBetween(-1, -1)
    hit = F.when(flag, 1).otherwise(0)
    return (
        df.withColumn("prior_seasons", F.count(F.lit(1)).over(earlier))
        .withColumn("prior_elite", F.coalesce(F.sum(hit).over(earlier), F.lit(0)).cast("long"))
        .withColumn("elite_last_season", F.coalesce(F.max(hit).over(last), F.lit(0)))
    )


def year_pairs(
    df: DataFrame, entity: Sequence[str], columns: Sequence[str], season: str = "season"
) -> DataFrame:
    """Each row beside the same entity's next season (``<column>_next``)."""
    after = df.select(
        *entity, (F.col(season) - 1).alias(season), *[F.col(c).alias(f"{c}_next") for c in columns]
    )
    return df.select(*entity, season, *columns).join(after, [*entity, season])


def previous_season(
    df: DataFrame, prior: DataFrame, entity: Sequence[str], columns: Sequence[str],
    suffix: str = "_prior", season: str = "season",
) -> DataFrame:
    """Left join of last season's values; missing stays NULL."""
    shifted = prior.select(
        *entity, (F.col(season) + 1).alias(season),
        *[F.col(c).alias(f"{c}{suffix}") for c in columns],
    )
    return df.join(shifted, [*entity, season], "left")


def stability_table(
    pairs: DataFrame, columns: Sequence[str], suffix: str = "_next", name: str = "r"
) -> DataFrame:
    """One row per column: correlation with its partner, and the pair count."""
    wide = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        *[correlation(F.col(c), F.col(f"{c}{suffix}")).alias(c) for c in columns],
    )
    stacked = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr("pairs", f"stack({len(columns)}, {stacked}) AS (stat, {name})")
