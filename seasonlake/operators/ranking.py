"""Ranks, positions, tiles and exact percentiles inside groups of any size.

``rank() OVER (PARTITION BY g ORDER BY v)`` sorts a whole group in one task. A group may
hold a third of all rows, so the functions here sort the whole frame by (group, value)
into ranges that Spark draws from a sample of the data, number the rows inside each
(group, range) and add the rows of the group's earlier ranges:

    position in group = position in (group, range) + rows in earlier ranges

A range holds about the same number of rows wherever the values lie and however they
crowd; a group has at most as many ranges as there are partitions. The ranges are stored
before they are counted, so every reader sees one and the same cut. Rank-like outputs
first collapse the rows to (group, value, count), so a value shared by many rows is one
row by then; positions are ranged by value and tie, so it is split over its ties.

``by`` of a rank must evaluate to the same value every time (integers, exact sums, ratios
of exact sums), since the ranks are joined back on it; pass ``pin=True`` for a float sum
or a random column, which stores the input first. ``bounded=True`` states that the size
of a group is limited by a fixed dimension (seasons, sources, teams) and uses the plain
window. ``source`` names a frame with the same (group, value) rows to count from: when
one frame gets several ranks, counting from the first frame keeps the plan flat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from seasonlake.functions.stats import correlation
from seasonlake.session import pinned

def _default(kind: T.DataType) -> Column:
    """Some value of the type, to stand in for NULL beside its flag."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(0)


def _directed(value: Column, descending: bool) -> Column:
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def _split_null(df: DataFrame, by: str) -> DataFrame:
    """Plain equality columns for a nullable value: windows and joins on them share a shuffle."""
    return df.withColumn("_isnull", F.col(by).isNull()).withColumn(
        "_val", F.coalesce(F.col(by), _default(df.schema[by].dataType))
    )


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows cut into consecutive ranges of the order and stored, numbered by ``_range``.

    Spark samples the rows to place the cuts, so ranges hold about equal shares whatever
    the values are, and adaptive execution joins neighbours that are small.
    """
    return pinned(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def range_offsets(stored: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """(keys, _range, _offset, total): a group's rows before each of its ranges."""
    cells = stored.groupBy(*keys, "_range").agg(size.alias("_size"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return cells.select(
        *keys, "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(group).alias("total"),
    )


def value_table(df: DataFrame, group: Sequence[str], by: str, descending: bool = False) -> DataFrame:
    """(group, _isnull, _val, n, before, total): how many rows precede each distinct value."""
    keys = list(group)
    values = _split_null(df, by).groupBy(*keys, "_isnull", "_val").agg(F.count(F.lit(1)).alias("n"))
    order = ["_isnull", F.col("_val").desc() if descending else F.col("_val").asc()]
    stored = ranged(values, [*keys, *order])
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        stored.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(range_offsets(stored, keys, F.sum("n")), [*keys, "_range"])
        .select(*keys, "_isnull", "_val", "n", (F.col("_inside") + F.col("_offset")).alias("before"), "total")
    )


def _rank_columns(before: Column, n: Column, total: Column, out: dict[str, str]) -> list[Column]:
    made = {
        "rank": (before + 1).cast("long"),
        "percent_rank": F.when(total > 1, before / (total - 1)).otherwise(F.lit(0.0)),
        "percent_rank_desc": F.when(total > 1, (total - before - n) / (total - 1)).otherwise(
            F.lit(0.0)
        ),
        "average_rank": before + (n + 1) / 2.0,
        "total": total.cast("long"),
    }
    return [made[kind].alias(name) for kind, name in out.items()]


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    by: str,
    descending: bool = False,
    bounded: bool = False,
    pin: bool = False,
    keep_null: bool = False,
    source: DataFrame | None = None,
    **out: str,
) -> DataFrame:
    """Add any of ``rank= percent_rank= percent_rank_desc= average_rank= total=`` (= output name).

    NULLs rank last in both directions and tie with each other; ``keep_null``
    leaves them unranked and out of the count instead.
    """
    keys = list(group)
    if pin:
        df = pinned(df)
    if keep_null:
        known = (df if source is None else source).where(F.col(by).isNotNull())
        if not bounded:
            table = _ranked_values(value_table(known, keys, by, descending), keys, out)
            return _split_null(df, by).join(table, [*keys, "_isnull", "_val"], "left").select(
                *df.columns, *out.values()
            )
        ranked = with_rank(df.where(F.col(by).isNotNull()), keys, by, descending, True, **out)
        return ranked.unionByName(df.where(F.col(by).isNull()), allowMissingColumns=True)
    if bounded:
        every = W.partitionBy(*keys)
        ordered = every.orderBy(_directed(F.col(by), descending))
        peers = W.partitionBy(*keys, by)
        ranked = df.withColumn("_before", (F.rank().over(ordered) - 1).cast("long"))
        ranked = ranked.withColumn("_total", F.count(F.lit(1)).over(every))
        if "average_rank" in out or "percent_rank_desc" in out:
            ranked = ranked.withColumn("_peers", F.count(F.lit(1)).over(peers))
        else:
            ranked = ranked.withColumn("_peers", F.lit(1))
        columns = _rank_columns(F.col("_before"), F.col("_peers"), F.col("_total"), out)
        return ranked.select(*df.columns, *columns)
    table = value_table(df if source is None else source, keys, by, descending)
    ranks = _ranked_values(table, keys, out)
    return _split_null(df, by).join(ranks, [*keys, "_isnull", "_val"]).select(
        *df.columns, *out.values()
    )


def _ranked_values(table: DataFrame, keys: list[str], out: dict[str, str]) -> DataFrame:
    columns = _rank_columns(F.col("before"), F.col("n"), F.col("total"), out)
    return table.select(*keys, "_isnull", "_val", *columns)


def with_position(
    df: DataFrame,
    group: Sequence[str],
    by: str,
    tie: str,
    descending: bool = True,
    name: str = "position_rank",
    total: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """ROW_NUMBER by ``by`` then the unique ``tie`` ascending; 1-based.

    The rows are stored once, so ``by`` may be any column, a random one included.
    """
    keys = list(group)
    order = [_directed(F.col(by), descending), F.col(tie).asc()]
    if bounded:
        every = W.partitionBy(*keys)
        out = df.withColumn(name, F.row_number().over(every.orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(every)) if total else out
    stored = ranged(df, [*keys, *order])
    offsets = range_offsets(stored, keys, F.count(F.lit(1))).withColumnRenamed("total", "_total")
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    rows = stored.withColumn("_inside", inside).join(offsets, [*keys, "_range"])
    made = [(F.col("_inside") + F.col("_offset")).cast("long").alias(name)]
    if total:
        made.append(F.col("_total").cast("long").alias(total))
    return rows.select(*[F.col(c) for c in df.columns], *made)


def tile_of(position: Column, total: Column, tiles: int) -> Column:
    """NTILE from a position: the first ``total % tiles`` tiles hold one row more."""
    size = F.floor(total / tiles)
    larger = total % tiles
    edge = larger * (size + 1)
    return (
        F.when(position <= edge, F.ceil(position / (size + 1)))
        .otherwise(larger + F.ceil((position - edge) / F.greatest(size, F.lit(1))))
        .cast("long")
    )


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "_rn"
) -> DataFrame:
    """First ``k`` rows per group with their position.

    Spark prunes to ``k`` rows per group in every input task before the shuffle
    (window group limit), so a large group never reaches one task whole.
    """
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def group_percentiles(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact continuous percentiles (linear interpolation) of non-NULL values."""
    keys = list(group)
    table = value_table(df.where(F.col(value).isNotNull()), keys, value)
    made = []
    for name, p in points.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        end = F.col("before") + F.col("n")
        for side, index in (("lo", low), ("hi", high)):
            hit = (F.col("before") <= index) & (index < end)
            made.append(F.max(F.when(hit, F.col("_val"))).alias(f"_{name}_{side}"))
        made.append(F.max(at - low).alias(f"_{name}_f"))
    picked = table.groupBy(*keys).agg(*made) if keys else table.agg(*made)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
            ).alias(n)
            for n in points
        ],
    )


def spearman(
    df: DataFrame, group: Sequence[str], left: str, right: str, name: str = "spearman",
    bounded: bool = False,
) -> DataFrame:
    """Rank correlation per group, ties at their average rank; NULL pairs dropped."""
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*group, left, right)
    pairs = both
    both = with_rank(both, group, left, bounded=bounded, average_rank="_left")
    both = with_rank(both, group, right, bounded=bounded, source=pairs, average_rank="_right")
    return both.groupBy(*group).agg(correlation(F.col("_left"), F.col("_right")).alias(name))
