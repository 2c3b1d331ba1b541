"""Settings rows out of the two nested league formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions import fixed_values as fixed, nested


def listed_slots(df: DataFrame, roster: str = "roster_positions") -> list:
    """One column per slot name from a list of position names."""
    return [
        nested.count_value(F.col(roster), value).alias(name)
        for name, value in fixed.ROSTER_SLOT_NAMES.items()
    ]


def settings_from_lists(
    df: DataFrame, platform: str, scoring: dict[str, str], keep: dict[str, str]
) -> DataFrame:
    """Settings with scoring as struct fields and the roster as a list of names."""
    return df.select(
        F.lit(platform).alias("league_key"), F.lit(platform).alias("platform"),
        *[F.col(source).alias(name) for name, source in keep.items()],
        *[F.col(source).cast("double").alias(name) for name, source in scoring.items()],
        *[F.lit(0.0).alias(name) for name in fixed.PUNT_STAT_IDS],
        *listed_slots(df),
    )


def settings_from_ids(
    df: DataFrame, platform: str, items: str, slots: str, keep: dict[str, str],
    ids: dict[str, int] | None = None, slot_ids: dict[str, str] | None = None,
) -> DataFrame:
    """Settings with scoring as a list of (stat id, points) and slots as a map by id."""
    wanted = ids or {**fixed.SCORING_STAT_IDS, **fixed.PUNT_STAT_IDS}
    return df.select(
        F.lit(platform).alias("league_key"), F.lit(platform).alias("platform"),
        *[F.col(source).alias(name) for name, source in keep.items()],
        *nested.points_by_id(F.col(items), wanted),
        *nested.slot_counts(F.col(slots), slot_ids or fixed.LINEUP_SLOT_IDS),
    )
