"""Values of distinct contents joined back to every row that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARES = 1000


def spread_join(rows: DataFrame, values: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` with the columns of ``values``, whose ``copies`` counts the rows of a key.

    ``values`` has each key once and should be stored. A key with more than a thousandth
    of all rows is dealt out over as many parts as it has thousandths; there are under
    ``HOT_SHARES`` of those, so their list can be broadcast at any size of the input, and
    their values are repeated at most twice that often.
    """
    total = values.agg(F.sum(copies)).first()[0] or 0
    share = max(1, -(-total // HOT_SHARES))
    parts = F.ceil(F.col(copies) / share).cast("int")
    hot = values.where(F.col(copies) > share).select(key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")), F.lit(0)).cast("int")
    )
    repeated = values.withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.when(F.col(copies) > share, parts - 1).otherwise(0)))
    )
    return dealt.join(repeated.drop(copies), [key, "_part"]).drop("_part", "_parts")
