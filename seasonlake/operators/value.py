"""Surplus over what a price has returned before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seasonlake.operators.curve import curve_at
from seasonlake.operators.ranking import with_rank
from seasonlake.session import pinned


def surplus_rows(
    board: DataFrame,
    curves: DataFrame,
    projected: DataFrame,
    x: str,
    entity: str = "entity_id",
    digits: int = 6,
) -> DataFrame:
    """Expected value from the curve, realised and projected surplus and centring, stored once.

    ``board`` holds played rows with actual_value and live rows without; ``curves``
    the points of one curve per (league, position, season). Surpluses are rounded to ``digits`` so
    that equal ones tie.
    """
    keys = ["league_key", "season"]
    cell = [*keys, "position"]
    curves = pinned(curves)
    trained = curves.groupBy(*cell).agg(F.max("curve_train_seasons").alias("curve_train_seasons"))
    expected = curve_at(curves, board, cell, x)
    df = board.join(trained, cell, "left").join(expected, [*cell, x], "left")
    df = df.withColumn("expected_value", F.round("expected_value", digits))
    df = df.join(projected, [*keys, entity], "left")
    df = df.withColumn(
        "surplus_value", F.round(F.col("actual_value") - F.col("expected_value"), digits)
    ).withColumn(
        "projected_surplus", F.round(F.col("projected_value") - F.col("expected_value"), digits)
    )
    df = pinned(df)
    means = df.groupBy(*keys).agg(F.avg("surplus_value").alias("_mean"))
    return df.join(F.broadcast(means), keys, "left").withColumn(
        "surplus_centered", F.col("surplus_value") - F.col("_mean")
    ).drop("_mean")


def surplus_ranks(rows: DataFrame) -> DataFrame:
    """``surplus_rows`` with both ranks, across positions inside (league, season)."""
    out = rows
    for value, name in (("surplus_value", "surplus_rank"), ("projected_surplus", "projected_surplus_rank")):
        out = with_rank(out, ["league_key", "season"], value, descending=True, keep_null=True, source=rows, rank=name)
    return out


def surplus_table(
    board: DataFrame,
    curves: DataFrame,
    projected: DataFrame,
    x: str,
    entity: str = "entity_id",
    digits: int = 6,
) -> DataFrame:
    """``surplus_rows`` of the board with both ranks."""
    return surplus_ranks(surplus_rows(board, curves, projected, x, entity, digits))
