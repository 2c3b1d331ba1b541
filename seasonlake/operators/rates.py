"""Pooled-fallback rates and luck-neutral totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def rate_with_fallback(
    df: DataFrame,
    pool: Sequence[str],
    group: Sequence[str],
    rates: dict[str, tuple[str, str]],
    min_volume: float = 5000,
) -> DataFrame:
    """Rate per (pool, group), replaced by the pool's rate below ``min_volume``.

    ``rates`` maps an output name to its (numerator, denominator) columns. The
    pooled rate is summed from the group sums, so the facts are read once.
    """
    columns = sorted({c for pair in rates.values() for c in pair})
    sums = df.groupBy(*pool, *group).agg(*[F.sum(c).alias(c) for c in columns])
    pooled = sums.groupBy(*pool).agg(
        *[
            (F.sum(n) / F.nullif(F.sum(d), F.lit(0))).alias(f"_{name}")
            for name, (n, d) in rates.items()
        ]
    )
    made = [
        F.coalesce(
            F.when(F.col(d) >= min_volume, F.col(n) / F.nullif(F.col(d), F.lit(0))),
            F.col(f"_{name}"),
        ).alias(name)
        for name, (n, d) in rates.items()
    ]
    return sums.join(pooled, list(pool)).select(*pool, *group, *made)


def luck_neutral(
    points: Column, parts: Sequence[tuple[float, Column, Column, Column]]
) -> Column:
    """Points with own scores removed and the expected ones added back.

    ``parts`` holds (value of one score, own scores, volume, rate per volume).
    """
    out = points
    for value, scored, volume, rate in parts:
        out = out - value * scored + value * volume * rate
    return out
