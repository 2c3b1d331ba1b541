"""Settings rows attached to facts: a literal for a handful, a join for a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.session import pinned

#: Settings rows that are sent to every task; more of them are joined by shuffle.
BROADCAST_SETTINGS = 1000


def with_settings(df: DataFrame, settings: Sequence[dict] | DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every row once per settings row, with the named fields attached.

    A list of settings is an exploded literal: no join and no shuffle. Of a table, the
    side with up to ``BROADCAST_SETTINGS`` rows is broadcast, the settings first. With
    more on both sides settings are dealt into chunks of that many and facts into shards;
    facts are copied to every chunk, settings to every shard, and each (chunk, shard) is
    a part of its own, so neither side is gathered and the output is made where both meet.
    """
    if not isinstance(settings, DataFrame):
        rows = [F.struct(*[F.lit(s[f]).alias(f) for f in fields]) for s in settings]
        exploded = df.withColumn("_settings", F.explode(F.array(*rows)))
        return exploded.select(*df.columns, *[F.col(f"_settings.{f}").alias(f) for f in fields])
    table = settings.select(F.struct(*fields).alias("_settings"))
    many = table.count()
    chunks = max(1, -(-many // BROADCAST_SETTINGS))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if chunks == 1:
        small, shards = "settings", 1
    else:
        df = pinned(df)
        shards = min(parts, max(1, -(-df.count() // BROADCAST_SETTINGS)))
        small = "facts" if shards == 1 else None
    if small == "facts":
        # a table of settings may be one short file, and its output is many times longer
        chunks, table = 1, table.repartition(parts)

    def dealt(rows: DataFrame, parts: int, own: str) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))

    def copied(rows: DataFrame, parts: int, other: str) -> DataFrame:
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    facts = copied(dealt(df, shards, "_shard"), chunks, "_chunk")
    table = copied(dealt(table, chunks, "_chunk"), shards, "_shard")
    # Spark takes a copied side for as small as it was, so the way of the join is named
    if small == "settings":
        table = F.broadcast(table)
    elif small == "facts":
        facts = F.broadcast(facts)
    else:
        facts = facts.hint("merge")
    joined = facts.join(table, ["_shard", "_chunk"])
    return joined.select(*df.columns, *[F.col(f"_settings.{f}").alias(f) for f in fields])


def by_position(position: Column, values: dict[str, Column]) -> Column:
    """The value that belongs to a row's position; NULL for other positions."""
    chain = None
    for name, value in values.items():
        hit = position == name
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def linear_points(
    prices: dict[str, str], pooled: Sequence[str] = (), pooled_price: str | None = None
) -> Column:
    """Sum of stat x price; the ``pooled`` stats are added up and priced once.

    Whole stats under whole prices stay whole, so their sum is exact.
    """
    total = F.lit(0)
    for stat, price in prices.items():
        total = total + F.col(stat) * F.col(price)
    if pooled:
        counted = sum((F.col(c) for c in pooled), F.lit(0))
        total = total + counted * F.col(pooled_price)
    return total
