"""What the operators of this folder share: reading a table and laying out a search grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def valid_vectors(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>): usable vectors, one per id.

    Null vectors, null or non-finite components, null ids and (on request) zero vectors
    are left out. Of rows that repeat an id the smallest vector stands, so that a
    repeated row is not found twice; the minimum combines before the shuffle.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    out = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    out = out.where(~F.coalesce(bad, F.lit(False)))
    if nonzero:
        out = out.where(F.exists("v", lambda x: x != 0))
    return out.groupBy("vec_id").agg(F.min("v").alias("v"))


def batches(batch: pa.RecordBatch, most_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts come to about ``most_bytes``."""
    sizes = batch.column(column).nbytes
    rows = batch.num_rows
    step = max(1, int(rows * most_bytes / max(sizes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def spread(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


BITMAP_BITS = 1 << 23


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit for each value of the only column of ``hashes``, by its low bits.

    A filter of fixed size: a set bit may be another value's, a clear one is proof. It
    spares work where few values are wanted and lets everything pass where many are.
    """
    at = F.pmod(F.col(hashes.columns[0]), F.lit(bits))
    words = hashes.select((at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.groupBy("word").agg(mask.alias("mask")).collect():
        out[row["word"]] = row["mask"]
    return out


def may_hold(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % (len(words) * 64)
    return (words[at // 64] >> (at % 64)) & 1 == 1
