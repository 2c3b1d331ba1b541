"""Dated snapshots assigned to the next labelled boundary of their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from seasonlake.operators.ranking import ranged


def forward_asof(
    snapshots: DataFrame,
    boundaries: DataFrame,
    group: Sequence[str],
    stamp: str,
    boundary: str,
    label: str,
) -> DataFrame:
    """First boundary on or after each snapshot in the same group; none drops the row.

    Snapshots and boundaries lie in one order of (group, time), cut into ranges that are
    drawn from the data: inside a range a snapshot takes the next boundary behind it, and
    a range's last snapshots take the first boundary of the group's later ranges. So a
    group of any size is spread, with dates or timestamps on either side, and neither
    rows nor boundaries are gathered. A snapshot without a time has no boundary.
    """
    keys = list(group)
    days = boundaries.where(F.col(boundary).isNotNull()).groupBy(*keys, F.col(boundary).alias("_at"))
    days = days.agg(F.struct(F.min(label).alias("label")).alias("_next"))
    rows = snapshots.where(F.col(stamp).isNotNull()).withColumn("_at", F.col(stamp))
    both = rows.unionByName(days, allowMissingColumns=True)
    both = both.withColumn("_mark", F.col("_next").isNotNull())
    stored = ranged(both, [*keys, "_at", "_mark"])
    behind = W.partitionBy(*keys, "_range").orderBy(F.col("_at").desc(), F.col("_mark").desc())
    behind = behind.rowsBetween(W.unboundedPreceding, 0)
    first = stored.groupBy(*keys, "_range").agg(F.min_by("_next", F.when(F.col("_mark"), F.col("_at"))).alias("_first"))
    later = W.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    first = first.select(*keys, "_range", F.last("_first", ignorenulls=True).over(later).alias("_carry"))
    found = stored.withColumn("_found", F.last("_next", ignorenulls=True).over(behind)).where(~F.col("_mark"))
    found = found.join(first, [*keys, "_range"])
    label_of = F.coalesce("_found", "_carry")["label"].alias(label)
    return found.select(*snapshots.columns, label_of).where(F.col(label).isNotNull())


def latest_per_label(
    mapped: DataFrame, group: Sequence[str], label: str, stamp: str
) -> DataFrame:
    """Rows of the newest snapshot of every (group, label)."""
    keys = [*group, label]
    newest = mapped.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return mapped.join(newest, [*keys, stamp], "left_semi")


def depth_chart(
    coarse: DataFrame,
    fine: DataFrame,
    week_start: DataFrame,
    starter_slots: dict[str, int],
    entity: str = "entity_id",
    stamp: str = "day",
) -> DataFrame:
    """One chart over two eras: a string number per week, or dated fine ranks.

    ``coarse`` has season, week, team, entity, position, string_team; ``fine`` has a
    date and depth_rank instead of a week and takes the week whose first game comes
    next, the last snapshot before it winning.
    """
    keys = ["season", "week", "team", entity, "position"]
    none = F.lit(None).cast("long")
    old = coarse.groupBy(*keys).agg(F.min("string_team").cast("long").alias("string_team"))
    old = old.withColumn("depth_rank", none)
    dates = fine.select("season", stamp).distinct()
    weeks = forward_asof(dates, week_start, ["season"], stamp, "first_game", "week")
    weeks = weeks.groupBy("season", "week").agg(F.max(stamp).alias(stamp))
    new = fine.join(weeks, ["season", stamp]).groupBy(*keys).agg(
        F.min("depth_rank").cast("long").alias("depth_rank")
    )
    new = new.withColumn("string_team", none)
    slots = F.create_map(*[F.lit(x) for pair in starter_slots.items() for x in pair])
    fits = F.col("depth_rank") <= F.try_element_at(slots, F.col("position"))
    return old.unionByName(new).withColumn(
        "is_starter", F.coalesce(F.col("string_team") == 1, fits)
    )
