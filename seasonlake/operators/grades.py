"""Group rates, percentile grades and the primary team of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions.stats import ratio_of_sums
from seasonlake.operators.ranking import with_rank


def group_rate(
    df: DataFrame, keys: Sequence[str], numerator: Column, denominator: Column, name: str
) -> DataFrame:
    """Ratio of sums per group."""
    return df.groupBy(*keys).agg(ratio_of_sums(numerator, denominator).alias(name))


def weighted_rate(
    df: DataFrame, keys: Sequence[str], value: Column, weight: Column, name: str
) -> DataFrame:
    """Weighted mean per group: sum(value * weight) / sum(weight)."""
    return df.groupBy(*keys).agg(ratio_of_sums(value * weight, weight).alias(name))


def percentile_grade(
    df: DataFrame,
    group: Sequence[str],
    by: str,
    name: str,
    lower_is_better: bool = False,
    bounded: bool = False,
    null_grade: bool = False,
) -> DataFrame:
    """0..100 grade from the percent rank inside ``group``.

    A missing value ranks last, so it gets the top direct grade and the bottom
    inverted one; ``null_grade`` leaves it ungraded instead.
    """
    out = with_rank(df, group, by, bounded=bounded, percent_rank=name)
    grade = F.lit(100.0) * (F.lit(1.0) - F.col(name) if lower_is_better else F.col(name))
    if null_grade:
        grade = F.when(F.col(by).isNotNull(), grade)
    return out.withColumn(name, grade)


def paired_grades(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    group: Sequence[str],
    left_rate: str,
    right_rate: str,
    left_grade: str,
    right_grade: str,
    name: str,
    bounded: bool = True,
    null_grade: bool = False,
) -> DataFrame:
    """Full outer join of two rates, one graded inverted and one direct, and their mean."""
    both = left.join(right, list(keys), "full")
    both = percentile_grade(both, group, left_rate, left_grade, True, bounded, null_grade)
    both = percentile_grade(both, group, right_rate, right_grade, False, bounded, null_grade)
    return both.withColumn(name, (F.col(left_grade) + F.col(right_grade)) / 2)


def primary_team(df: DataFrame, keys: Sequence[str], team: str, when: str) -> DataFrame:
    """The team seen most often per key; ties to the latest ``when``, then by name.

    Two partial aggregations, no window: a key never needs its rows in one place.
    """
    seen = df.where(F.col(team).isNotNull()).groupBy(*keys, team).agg(
        F.count(F.lit(1)).alias("_n"), F.max(when).alias("_last")
    )
    order = F.struct(-F.col("_n"), -F.col("_last"), F.col(team))
    return seen.groupBy(*keys).agg(F.min_by(team, order).alias(team))
