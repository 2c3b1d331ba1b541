"""Replacement level with pooled flexible slots, and points over replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from seasonlake.operators.ranking import top_k, with_position
from seasonlake.operators.settings import by_position


def deepest_rank(
    settings: Sequence[dict], slots: dict[str, str], flex: Sequence[tuple[str, Sequence[str]]]
) -> int:
    """The lowest rank any replacement level can fall on, from the settings alone."""
    return 1 + max(
        int(s["team_count"])
        * (max(int(s[c]) for c in slots.values()) + sum(int(s[c]) for c, _ in flex))
        for s in settings
    )


def replacement_levels(
    pool: DataFrame,
    keys: Sequence[str],
    slots: dict[str, str],
    flex: Sequence[tuple[str, Sequence[str]]],
    depth: int,
    position: str = "position",
    points: str = "league_points",
    entity: str = "entity_id",
) -> DataFrame:
    """(keys, position): starters and the points of the first one left off.

    Dedicated slots fill first; then each (slot column, eligible positions) pool
    in order takes the best of what is left. Only the ``depth`` best rows per
    position can matter, so only those cross the network.
    """
    ordered = [F.col(points).desc_nulls_last(), F.col(entity).asc()]
    teams = F.col("team_count")
    top = top_k(pool, [*keys, position], ordered, depth)
    top = top.withColumn(
        "_dedicated", teams * by_position(F.col(position), {p: F.col(c) for p, c in slots.items()})
    )
    top = top.withColumn("_in", F.col("_rn") <= F.col("_dedicated")).withColumn("_won", F.lit(0))
    for slot, eligible in flex:
        open_row = F.col(position).isin(*eligible) & ~F.col("_in")
        queue = W.partitionBy(*keys).orderBy(open_row.desc(), *ordered)
        won = open_row & (F.row_number().over(queue) <= teams * F.col(slot))
        top = top.withColumn("_hit", won)
        top = top.withColumn("_won", F.col("_won") + F.col("_hit").cast("int"))
        top = top.withColumn("_in", F.col("_in") | F.col("_hit")).drop("_hit")
    cell = W.partitionBy(*keys, position)
    top = top.withColumn("_starters", F.col("_dedicated") + F.sum("_won").over(cell))
    last = F.least(F.col("_starters") + 1, F.count(F.lit(1)).over(cell))
    return top.withColumn("_last", last).where(F.col("_rn") == F.col("_last")).select(
        *keys,
        position,
        F.col("_starters").cast("long").alias("starters_at_position"),
        F.col(points).alias("replacement_level_points"),
    )


def points_over_replacement(
    pool: DataFrame,
    keys: Sequence[str],
    slots: dict[str, str],
    flex: Sequence[tuple[str, Sequence[str]]],
    depth: int,
    position: str = "position",
    points: str = "league_points",
    entity: str = "entity_id",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Position rank, replacement level and the difference, for every row of the pool.

    ``keep`` names the columns that rows carry along; all of the pool's if not given.
    """
    levels = replacement_levels(pool, keys, slots, flex, depth, position, points, entity)
    carried = pool if keep is None else pool.select(*keys, position, entity, points, *keep)
    ranked = with_position(carried, [*keys, position], points, entity)
    joined = ranked.join(levels, [*keys, position])
    return joined.withColumn(
        "points_over_replacement", F.col(points) - F.col("replacement_level_points")
    )
