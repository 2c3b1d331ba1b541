"""Search of a query set against all rows, in blocks, and the merge of the blocks.

Candidates are dealt to shards and queries to blocks by a hash of their unique id; a cell
(shard, block) meets in one task. Both counts follow the row counts, so a cell stays as
large at any size: a candidate travels once per block, a query once per shard.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonlake.llm.common import spread


def search_cells(
    rows: DataFrame, queries: DataFrame, cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str, rows_per_shard: int, queries_per_block: int,
) -> DataFrame:
    """Run ``cell(candidates, queries)`` for every shard and block.

    Both frames have a unique ``vec_id``.
    """
    shards = max(1, -(-rows.count() // rows_per_shard))
    blocks = max(1, -(-queries.count() // queries_per_block))
    left = rows.withColumn("shard", spread(F.col("vec_id"), shards)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = queries.withColumn("block", spread(F.col("vec_id"), blocks)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    return (
        left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, schema)
    )


def merge_top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query over all shards, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
