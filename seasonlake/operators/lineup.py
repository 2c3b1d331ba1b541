"""Rosters: dealing a board, best lineups, format variants and opening compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from seasonlake.functions.fixed_values import OPENING_CAPS, SUPERFLEX_QB_CAP
from seasonlake.operators.settings import by_position


def snake(pick: Column, teams: Column) -> tuple[Column, Column]:
    """(round, team), 1-based, of a 1-based pick; every second round runs backwards."""
    zero = pick - 1
    turn = F.floor(zero / teams).cast("long")
    seat = zero % teams
    team = F.when(turn % 2 == 0, seat).otherwise(teams - 1 - seat)
    return (turn + 1), (team + 1).cast("long")


def lineup_value(
    rosters: DataFrame,
    keys: Sequence[str],
    slots: dict[str, str],
    pools: Sequence[tuple[str, Sequence[str]]],
    position: str = "position",
    points: str = "league_points",
    entity: str = "entity_id",
    name: str = "starter_points",
) -> DataFrame:
    """Best starting total of each roster: dedicated slots, then each pool in order.

    A later pool must accept everything the earlier one does; filling the
    restrictive slot first is then optimal. A roster is as long as a draft.
    """
    best = [F.col(points).desc_nulls_last(), F.col(entity).asc()]
    place = F.row_number().over(W.partitionBy(*keys, position).orderBy(*best))
    own = by_position(F.col(position), {p: F.col(c) for p, c in slots.items()})
    df = rosters.withColumn("_in", place <= own)
    for slot, eligible in pools:
        open_row = F.col(position).isin(*eligible) & ~F.col("_in")
        queue = F.row_number().over(W.partitionBy(*keys).orderBy(open_row.desc(), *best))
        df = df.withColumn("_hit", open_row & (queue <= F.col(slot)))
        df = df.withColumn("_in", F.col("_in") | F.col("_hit")).drop("_hit")
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_in"), F.col(points))), F.lit(0.0)).alias(name)
    )


def format_variants(df: DataFrame, slots: Sequence[str], qb_cap: int = 2) -> DataFrame:
    """Each settings row as ``1qb`` and ``superflex``.

    A gained superflex slot comes from a flex spot, else the bench; a lost one goes
    back to flex. Draft rounds, the quarterback cap and the real format follow.
    """
    out = df.withColumn("variant", F.explode(F.array(F.lit("1qb"), F.lit("superflex"))))
    wanted = F.when(F.col("variant") == "superflex", 1).otherwise(0)
    actual = F.when(F.col("superflex_slots") > 0, "superflex").otherwise("1qb")
    out = out.withColumn("is_actual", F.col("variant") == actual).withColumn(
        "_delta", wanted - F.col("superflex_slots")
    )
    taken = F.when(F.col("_delta") > 0, F.least("_delta", "flex_slots")).otherwise(F.col("_delta"))
    out = out.withColumn("_flex", taken)
    bench = F.when(F.col("_delta") > 0, F.col("_delta") - F.col("_flex")).otherwise(F.lit(0))
    out = (
        out.withColumn("bench_slots", F.col("bench_slots") - bench)
        .withColumn("flex_slots", F.col("flex_slots") - F.col("_flex"))
        .withColumn("superflex_slots", F.col("superflex_slots") + F.col("_delta"))
    )
    dedicated = sum((F.col(c) for c in slots), F.lit(0))
    rounds = dedicated + F.col("flex_slots") + F.col("superflex_slots") + F.col("bench_slots")
    cap = F.when(F.col("superflex_slots") > 0, SUPERFLEX_QB_CAP).otherwise(qb_cap)
    return out.withColumn("rounds", rounds).withColumn("qb_cap", cap).drop("_delta", "_flex")


def _named(caps: dict[str, int]) -> str:
    """An inline table of (place, name, most), the positions in their order."""
    rows = ", ".join(f"({i}, '{name}', {most})" for i, (name, most) in enumerate(caps.items()))
    return f"(VALUES {rows}) AS v(place, name, most)"


def compositions(spark: SparkSession, caps: dict[str, int] = OPENING_CAPS, picks: int = 5) -> DataFrame:
    """(label, counts): every count vector over the positions that fills ``picks`` within the caps.

    A recursion over the positions: each step gives the next position each count that
    its cap and the picks left allow. ``counts`` maps the positions taken to their counts.
    """
    return spark.sql(f"""
        WITH RECURSIVE names AS (SELECT * FROM {_named(caps)}), grown(place, left_over, label, counts) AS (
            SELECT 0, {picks}, '', CAST(map() AS MAP<STRING, INT>)
            UNION ALL
            SELECT grown.place + 1, left_over - n,
                concat(label, if(n > 0, concat(n, name), '')), if(n > 0, map_concat(counts, map(name, n)), counts)
            FROM grown JOIN names ON names.place = grown.place
            LATERAL VIEW explode(sequence(0, least(most, left_over))) AS n
        )
        SELECT label, counts FROM grown WHERE place = {len(caps)} AND left_over = 0
    """)


def orderings(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(sequence): every distinct order that uses each position the given number of times.

    A recursion over the remaining counts: each step picks a position that is not used up.
    """
    wanted = {n: c for n, c in counts.items() if c}
    left = "map(" + ", ".join(f"'{n}', {c}" for n, c in wanted.items()) + ")"
    return spark.sql(f"""
        WITH RECURSIVE grown(taken, sequence, remaining) AS (
            SELECT 0, CAST(array() AS ARRAY<STRING>), {left}
            UNION ALL
            SELECT taken + 1, concat(sequence, array(name)),
                transform_values(remaining, (k, v) -> if(k = name, v - 1, v))
            FROM grown LATERAL VIEW explode(map_keys(map_filter(remaining, (k, v) -> v > 0))) AS name
        )
        SELECT array_join(sequence, '-') AS sequence FROM grown WHERE taken = {sum(wanted.values())}
    """)
