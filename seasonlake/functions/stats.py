"""Statistical aggregates and rules as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: numerator and denominator both skip rows where ``value`` is NULL."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def ratio_of_sums(numerator: Column, denominator: Column) -> Column:
    """Aggregate: sum / sum, NULL when the denominator is zero."""
    return F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0))


def share(predicate: Column) -> Column:
    """Aggregate: share of rows, a NULL predicate counts as not met."""
    return F.avg(F.when(predicate, 1.0).otherwise(0.0))


def mean_of(values: Sequence[Column]) -> Column:
    """Row-wise mean of the non-NULL values."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    count = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(count > 0, total / count)


def blend_two(a: Column, b: Column) -> Column:
    """Mean of two values, or whichever exists."""
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def floor_at(value: Column, low: float) -> Column:
    """Lower bound that keeps NULL (``greatest`` alone would drop it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def cap_at(value: Column, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(high)))


def recency_tenths(gap: Column, tenths: dict[int, int]) -> Column:
    """Integer recency weight (tenths) by seasons back; exact in sums."""
    chain = None
    for back, weight in tenths.items():
        chain = F.when(gap == back, weight) if chain is None else chain.when(gap == back, weight)
    return chain


def one_hot(value: Column, levels: Sequence[str], prefix: str) -> list[Column]:
    """0/1 column per level of a fixed list; other values give all zeros."""
    return [
        F.coalesce((value == level).cast("int"), F.lit(0)).alias(f"{prefix}_{level}")
        for level in levels
    ]


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates: n, mae, rmse and R2 = 1 - SSres / SStot.

    Squares are floats: those of whole cents pass a long's range within a few 100,000 rows.
    """
    residual = (actual - predicted).cast("double")
    both = residual.isNotNull()
    spread = F.var_pop(F.when(both, actual)) * F.count(residual)
    return {
        "n": F.count(residual),
        "mae": F.avg(F.abs(residual)),
        "rmse": F.sqrt(F.avg(residual * residual)),
        "r2": F.lit(1.0) - F.sum(residual * residual) / F.nullif(spread, F.lit(0.0)),
    }


def coverage_metrics(actual: Column, low: Column, high: Column) -> dict[str, Column]:
    """Aggregates: share of actuals under each quantile and crossed intervals."""
    return {
        "below_low": F.avg((actual <= low).cast("double")),
        "below_high": F.avg((actual <= high).cast("double")),
        "crossed": F.count_if(high < low),
    }


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of complete pairs, NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(spread))


def through_origin(x: Column, y: Column) -> Column:
    """Aggregate: least-squares slope of a line through the origin."""
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0))


def standard_error(value: Column) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def t_of_mean(value: Column) -> Column:
    """Aggregate: mean over its standard error, NULL when there is no spread."""
    return F.avg(value) / F.nullif(standard_error(value), F.lit(0.0))


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t for whole degrees of freedom.

    The finite trigonometric series in theta = atan(t / sqrt(df)).
    """
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def series(count: Column, factor) -> Column:
        # one step per term: the running term and the running sum travel together
        steps = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )

        def step(acc, k):
            term = acc["term"] * factor(k) * cos2
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(steps, zero, step)["sum"]

    even = F.lit(1.0) - F.sin(theta) * series(
        (df / 2).cast("int") - 1, lambda k: (2 * k - 1) / (2 * k)
    )
    tail = series(((df - 3) / 2).cast("int"), lambda k: (2 * k) / (2 * k + 1))
    odd = F.lit(1.0) - F.lit(2.0 / math.pi) * (
        theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * tail).otherwise(F.lit(0.0))
    )
    return F.when(df >= 1, F.when(df % 2 == 0, even).otherwise(odd))
