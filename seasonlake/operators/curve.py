"""Monotone value curves per group, fitted walk-forward, and through-origin scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from seasonlake.functions.stats import through_origin
from seasonlake.operators.history import later_seasons
from seasonlake.session import pinned

#: Corner points of all curves of one fit; the fitted model is one object on the driver.
MOST_POINTS = 5_000_000


def monotone_points(points: DataFrame, keys: Sequence[str], x: str, total: str, weight: str) -> DataFrame:
    """(keys, x, y): the non-increasing isotonic fit at every point of every group.

    ``points`` has one row per (keys, x) with pre-aggregated sums. All groups are one
    distributed fit: each is shifted to its own stretch of x, below the group before it
    by more than the values range, so no block of the fit reaches over two groups. The
    fit decides which points are pooled; their level is then summed from the points
    themselves. More than ``MOST_POINTS`` points are refused: bin x first.
    """
    keys = list(keys)
    points = pinned(
        points.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (total, "total"), (weight, "weight"))])
    )
    level = F.col("total") / F.col("weight")
    size, low, high, least, most = points.agg(
        F.count(F.lit(1)), F.min("x"), F.max("x"), F.min(level), F.max(level)
    ).first()
    if not size:
        return points.select(*keys, "x", F.col("total").alias("y"))
    if size > MOST_POINTS:
        raise ValueError(f"{size} curve points; bin {x} so that at most {MOST_POINTS} are left")
    groups = points.select(*keys).distinct().withColumn("_g", F.row_number().over(W.orderBy(*keys)))
    placed = points.join(groups, keys).withColumns(
        {
            "_at": F.col("_g") * (high - low + 1.0) + (F.col("x") - low),
            "_level": level - F.col("_g") * (most - least + 1.0),
        }
    )
    fit = IsotonicRegression(
        isotonic=False, featuresCol="_at", labelCol="_level", weightCol="weight", predictionCol="_block"
    ).fit(placed)
    # summed in the order of x, so that a block's level is the same in every run
    block = W.partitionBy(*keys, "_block").orderBy("x").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return fit.transform(placed).select(
        *keys, "x", (F.sum("total").over(block) / F.sum("weight").over(block)).alias("y")
    )


def curve_at(curves: DataFrame, wanted: DataFrame, keys: Sequence[str], x: str, name: str = "expected_value") -> DataFrame:
    """(keys, x, name): the curves read at the distinct ``x`` of ``wanted``.

    Linear between neighbouring points, clipped outside the fitted range, NULL where the
    group has no curve. Only distinct places are looked up, in order beside the points
    of their group; rows join the result on (keys, x), no row carries a curve.
    """
    keys = list(keys)
    at = F.col(x).cast("double").alias("_x")
    asked = wanted.where(F.col(x).isNotNull()).select(*keys, x, at).distinct()
    known = curves.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"))
    places = asked.select(*keys, "_x").unionByName(known, allowMissingColumns=True)
    places = places.groupBy(*keys, "_x").agg(F.max("_y").alias("_y"))
    point = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    group = W.partitionBy(*keys)
    behind = group.orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    ahead = group.orderBy(F.col("_x").desc()).rowsBetween(W.unboundedPreceding, 0)
    places = places.withColumn("_l", F.last(point, ignorenulls=True).over(behind))
    places = places.withColumn("_r", F.last(point, ignorenulls=True).over(ahead))
    left, right = F.col("_l"), F.col("_r")
    slope = (right["_y"] - left["_y"]) / F.nullif(right["_x"] - left["_x"], F.lit(0.0))
    value = (
        F.when(left.isNull(), right["_y"])
        .when(right.isNull() | (left["_x"] == right["_x"]), left["_y"])
        .otherwise(left["_y"] + slope * (F.col("_x") - left["_x"]))
    )
    return asked.join(places.select(*keys, "_x", value.alias(name)), [*keys, "_x"]).drop("_x")


def walk_forward_curve(
    played: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    last: Column,
    min_seasons: int = 3,
    min_rows: int = 60,
    season: str = "season",
) -> DataFrame:
    """(keys, season, curve_train_seasons, x, y): curves fitted on strictly earlier seasons.

    ``last`` is the newest season to predict. Rows shrink to (keys, season, x) sums
    before they are repeated per target, so the repetition is of the grid only. A curve
    is its points, one row each, for ``curve_at``.
    """
    keys = list(keys)
    grid = played.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, season, x).agg(
        F.sum(y).alias("total"), F.count(F.lit(1)).alias("weight")
    )
    grid = later_seasons(grid, last, season, "_target")
    cell = [*keys, "_target"]
    per_season = grid.groupBy(*cell, season).agg(F.sum("weight").alias("rows"))
    enough = per_season.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("curve_train_seasons"), F.sum("rows").alias("rows")
    )
    enough = enough.where(
        (F.col("curve_train_seasons") >= min_seasons) & (F.col("rows") >= min_rows)
    ).drop("rows")
    train = grid.groupBy(*cell, x).agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    train = train.join(enough.select(*cell), cell, "left_semi")
    curves = monotone_points(train, cell, x, "total", "weight")
    return curves.join(enough, cell).withColumnRenamed("_target", season)


def origin_scale(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "scale") -> DataFrame:
    """Through-origin coefficient of y on x per group."""
    return df.where(F.col(x) > 0).groupBy(*keys).agg(
        through_origin(F.col(x).cast("double"), F.col(y).cast("double")).alias(name)
    )
