"""Scoring predictions fold by fold: errors, rank agreement, hits, calibration, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions.stats import error_metrics, student_two_sided
from seasonlake.operators.ranking import group_percentiles, spearman, top_k
from seasonlake.session import pinned


def stack_predictions(df: DataFrame, keep: Sequence[str], predictions: dict[str, str]) -> DataFrame:
    """Long form: one row per (row, prediction)."""
    parts = ", ".join(f"'{name}', CAST(`{column}` AS DOUBLE)" for name, column in predictions.items())
    return df.selectExpr(*keep, f"stack({len(predictions)}, {parts}) AS (prediction, predicted)")


def top_hits(
    df: DataFrame, group: Sequence[str], predicted: str, actual: str, entity: str, tops: dict[str, int]
) -> DataFrame:
    """How many of the predicted top n finished in the actual top n, for several n at once.

    Groups without a single hit are absent.
    """
    keys, deepest = list(group), max(tops.values())
    said = top_k(df, keys, [F.col(predicted).desc_nulls_last(), F.col(entity).asc()], deepest, "_said")
    did = top_k(df, keys, [F.col(actual).desc_nulls_last(), F.col(entity).asc()], deepest, "_did")
    both = said.select(*keys, entity, "_said").join(did.select(*keys, entity, "_did"), [*keys, entity])
    return both.groupBy(*keys).agg(
        *[F.count_if((F.col("_said") <= n) & (F.col("_did") <= n)).alias(name) for name, n in tops.items()]
    )


def fold_metrics(
    folds: DataFrame,
    group: Sequence[str],
    actual: str,
    predicted: str,
    entity: str,
    tops: Sequence[int] = (5, 10),
) -> DataFrame:
    """n, mae, rmse, R2, Spearman and hits per group; rank metrics NULL for a constant."""
    keys = list(group)
    made = {n: c.alias(n) for n, c in error_metrics(F.col(actual), F.col(predicted)).items()}
    flat = folds.groupBy(*keys).agg(
        *made.values(), (F.max(predicted) > F.min(predicted)).alias("_ordered")
    )
    out = flat.join(spearman(folds, keys, predicted, actual), keys, "left")
    names = {f"top{n}_hits": n for n in tops}
    if names:
        out = out.join(top_hits(folds, keys, predicted, actual, entity, names), keys, "left")
    hits = [F.coalesce(name, F.lit(0).cast("long")) for name in names]
    return out.select(
        *keys, *made,
        F.when(F.col("_ordered"), F.col("spearman")).alias("spearman"),
        *[F.when(F.col("_ordered"), h).alias(n) for n, h in zip(names, hits)],
    )


def benchmark_metrics(
    scored: DataFrame,
    group: Sequence[str],
    pool: str,
    actual: str,
    predicted: str,
    naive: str,
    market: str,
    entity: str,
    min_rows: int = 20,
) -> DataFrame:
    """Model, carry-forward and market per group and pooled over ``pool`` as ``ALL``.

    The market (low is better) is scored on the rows it covers, and the model once
    more on those same rows; a group or a covered part below ``min_rows`` gets none.
    """
    keys = [*group, pool]
    rows = scored.unionByName(scored.withColumn(pool, F.lit("ALL")))

    def score(df: DataFrame, column: str) -> DataFrame:
        return fold_metrics(df, keys, actual, column, entity, tops=())

    model = score(rows, predicted).where((F.col("n") >= min_rows) | (F.col(pool) == "ALL"))
    carried = score(rows, naive).select(
        *keys, F.col("mae").alias("naive_mae"), F.col("spearman").alias("naive_spearman")
    )
    covered = rows.where(F.col(market).isNotNull()).withColumn("_market", -F.col(market))
    said = score(covered, "_market").where(F.col("n") >= min_rows).select(
        *keys, F.col("n").alias("market_n"), F.col("spearman").alias("market_spearman")
    )
    same = score(covered, predicted).select(*keys, F.col("spearman").alias("model_spearman_vs_market"))
    return model.drop("rmse").join(carried, keys).join(said.join(same, keys), keys, "left")


def games_metrics(
    rows: DataFrame, group: Sequence[str], actual: str, expected: str, naive: str
) -> DataFrame:
    """games_n, games_mae and games_naive_mae per group, over everyone with a known count."""
    known = rows.where(F.col(actual).isNotNull())
    return known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("games_n"), F.avg(F.abs(F.col(actual) - F.col(expected))).alias("games_mae"),
        F.avg(F.abs(F.col(actual) - F.col(naive))).alias("games_naive_mae"),
    )


def backtest_table(
    scored: DataFrame,
    newcomers: DataFrame,
    availability: DataFrame,
    group: Sequence[str],
    pool: str,
    actual: str,
    predicted: str,
    naive: str,
    market: str,
    entity: str,
    min_rows: int = 20,
) -> DataFrame:
    """``benchmark_metrics`` with the row ``NO_BASELINE`` and, on ``ALL``, the games columns.

    ``newcomers`` are rows without a history; their ``naive`` is the mean of the training
    slice (``slice_means``), and rows from before there was one are left out.
    ``availability`` holds (group, games_n, games_mae, games_naive_mae).
    """
    keys = [*group, pool]
    rows = benchmark_metrics(scored, group, pool, actual, predicted, naive, market, entity, min_rows)
    known = newcomers.where(F.col(naive).isNotNull()).withColumn(pool, F.lit("NO_BASELINE"))
    fresh = benchmark_metrics(pinned(known), group, pool, actual, predicted, naive, market, entity, min_rows)
    rows = rows.unionByName(fresh.where(F.col(pool) == "NO_BASELINE"))
    return rows.join(availability.withColumn(pool, F.lit("ALL")), keys, "left")


def quantile_bins(
    df: DataFrame, by: str, bins: int, group: Sequence[str] = ()
) -> DataFrame:
    """Bin number 1.. by empirical quantile edges; equal edges collapse.

    Edges come from the distributed percentile, one row per group; the first bin
    includes its left edge.
    """
    keys = list(group)
    points = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = group_percentiles(df, keys, by, points)
    edges = edges.select(*keys, F.array_distinct(F.array(*points)).alias("_edges"))
    if keys:
        joined = df.join(edges, keys)
    else:
        joined = df.withColumn("_edges", edges.scalar())
    above = F.size(F.filter("_edges", lambda e: e < F.col(by)))
    return joined.withColumn("bin", F.greatest(above, F.lit(1)).cast("long")).drop("_edges")


def clustered_test(
    df: DataFrame,
    group: Sequence[str],
    cluster: str,
    value: str,
    zero_spread: float = 1e-6,
) -> DataFrame:
    """t-test of cluster means against zero.

    Means whose spread is floating-point dust count as exactly zero, and such a
    group, or one with a single cluster, has no test.
    """
    keys = list(group)
    means = df.groupBy(*keys, cluster).agg(F.avg(value).alias("_m"))
    # one row per cluster of a group
    flat = means.groupBy(*keys).agg(
        F.count("_m").alias("n_clusters"),
        F.count_if(F.col("_m") > 0).alias("_positive"),
        F.avg("_m").alias("_mean"),
        F.stddev_samp("_m").alias("_sd"),
        (F.max("_m") - F.min("_m")).alias("_spread"),
    )
    real = F.col("_spread") >= zero_spread
    tested = (F.col("n_clusters") > 1) & (F.col("_spread") > zero_spread)
    t = F.when(tested, F.col("_mean") / (F.col("_sd") / F.sqrt(F.col("n_clusters"))))
    out = flat.withColumn("t_stat", t)
    # a single cluster has no spread either, so its mean counts as zero too
    return out.select(
        *keys,
        "n_clusters",
        F.when(real, F.col("_positive")).otherwise(0).cast("long").alias("clusters_positive"),
        "t_stat",
        student_two_sided(F.col("t_stat"), F.col("n_clusters") - 1).alias("p_value"),
    )


__all__ = [
    "benchmark_metrics", "clustered_test", "fold_metrics", "quantile_bins", "stack_predictions", "top_hits",
]
