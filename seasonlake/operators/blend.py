"""Several sources for one number: consensus statistics, pivots and two-source blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions.stats import blend_two


def union_sources(arms: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """UNION ALL by name of arms stamped with their source."""
    stamped = [df.withColumn(label, F.lit(name)) for name, df in arms.items()]
    out = stamped[0]
    for arm in stamped[1:]:
        out = out.unionByName(arm, allowMissingColumns=True)
    return out


def consensus(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sources: Sequence[str],
    labels: Sequence[Column] = (),
    source: str = "source",
    scale: float = 1.0,
) -> DataFrame:
    """Count, range, p20/p50/p80, sample deviation and one column per source.

    Expects at most one row per (key, source), so a group holds no more rows than
    there are sources and the exact percentile stays small.
    """
    at = F.col(value)
    scaled = (lambda c: c / scale) if scale != 1.0 else (lambda c: c)
    known = df.where(at.isNotNull()).dropna(subset=list(keys))
    return known.groupBy(*keys).agg(
        *labels,
        F.count(F.lit(1)).alias("num_sources"),
        scaled(F.min(at)).alias("min_points"),
        scaled(F.max(at)).alias("max_points"),
        scaled(F.percentile(at, 0.2)).alias("floor_p20"),
        scaled(F.percentile(at, 0.5)).alias("median_p50"),
        scaled(F.percentile(at, 0.8)).alias("ceiling_p80"),
        scaled(F.stddev_samp(at)).alias("stddev_points"),
        *[
            scaled(F.max(F.when(F.col(source) == s, at))).alias(f"{s}_points")
            for s in sources
        ],
    )


def crosswalk(
    fact: DataFrame, ids: DataFrame, fact_key: Column, ids_key: Column, position: str = "position"
) -> DataFrame:
    """Inner join to the id dimension on (platform id, position); NULL keys never match."""
    left = fact.withColumn("_key", fact_key).withColumnRenamed(position, "_position")
    right = ids.withColumn("_key", ids_key).withColumnRenamed(position, "_position")
    return left.join(right, ["_key", "_position"]).drop("_key").withColumnRenamed(
        "_position", position
    )


def reject_ambiguous(ids: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Keep only keys that name exactly one entity, so a name join cannot fan out."""
    return (
        ids.groupBy(*keys)
        .agg(F.min(entity).alias(entity), F.max(entity).alias("_other"))
        .where(F.col(entity) == F.col("_other"))
        .drop("_other")
    )


def two_source_blend(
    a: DataFrame, b: DataFrame, keys: Sequence[str], a_value: str, b_value: str,
    name: str, count: str = "num_sources",
) -> DataFrame:
    """Full outer join of two priced lists; mean if both, else whichever exists."""
    both = a.join(b, list(keys), "full")
    x, y = F.col(a_value), F.col(b_value)
    return both.withColumn(name, blend_two(x, y)).withColumn(
        count, x.isNotNull().cast("int") + y.isNotNull().cast("int")
    )


def latest_shared_season(feeds: Sequence[DataFrame], season: str = "season") -> DataFrame:
    """One row: the newest season any of the feeds represents (text seasons are cast)."""
    tops = [
        df.agg(F.max(F.col(season).try_cast("bigint")).alias("season")) for df in feeds
    ]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out.agg(F.max("season").alias("season"))
