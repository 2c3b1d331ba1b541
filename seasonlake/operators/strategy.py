"""Summaries over a table of trial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from seasonlake.functions.stats import share
from seasonlake.operators.folds import clustered_test

ZERO_SPREAD = 1e-6


def against_field(
    totals: DataFrame, trial: Sequence[str], value: str = "starter_points"
) -> DataFrame:
    """Each member against the mean of the others in its trial, and its finish.

    A trial has as many members as a league has teams.
    """
    every = W.partitionBy(*trial)
    v = F.col(value)
    others = (F.sum(value).over(every) - v) / F.nullif(F.count(value).over(every) - 1, F.lit(0))
    finish = F.rank().over(every.orderBy(v.desc()))
    return (
        totals.withColumn("field_points", others)
        .withColumn("points_vs_field", v - F.col("field_points"))
        .withColumn("finish_rank", finish.cast("long"))
    )


def strategy_summary(
    results: DataFrame, keys: Sequence[str], season: str = "season", value: str = "points_vs_field"
) -> DataFrame:
    """One row per strategy with a season-clustered t-test."""
    flat = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_drafts"),
        F.avg("starter_points").alias("starter_points"),
        F.avg(value).alias("points_vs_field"),
        F.avg("finish_rank").alias("finish_rank"),
        share(F.col("finish_rank") == 1).alias("win_rate"),
        share(F.col("finish_rank") <= F.ceil(F.col("team_count") / 3)).alias("top_third_rate"),
    )
    tests = clustered_test(results, keys, season, value, ZERO_SPREAD)
    tests = tests.withColumnRenamed("n_clusters", "n_seasons").withColumnRenamed(
        "clusters_positive", "seasons_positive"
    )
    return flat.join(tests, list(keys))


def in_every_group(df: DataFrame, key: str, group: str, every: DataFrame | None = None) -> DataFrame:
    """Keys present in every group of ``every``, or of ``df`` itself.

    A group of ``every`` that has no row in ``df`` leaves no key: nothing is in all of them.
    """
    groups = (df if every is None else every).agg(F.countDistinct(group).alias("n")).scalar()
    counted = df.groupBy(key).agg(F.countDistinct(group).alias("_n"))
    return counted.where(F.col("_n") == groups).select(key)
