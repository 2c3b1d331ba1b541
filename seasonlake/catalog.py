"""Tables: idempotent writes, archives, listings and read-only queries."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from seasonlake.functions.fixed_values import SILVER_PREFIXES


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


_VERSION = "__v_"


def _versions(spark: SparkSession, name: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables() if t.name.startswith(name.lower() + _VERSION)]


def _drop(spark: SparkSession, name: str) -> None:
    kind = "VIEW" if spark.catalog.getTable(_quoted(name)).tableType == "VIEW" else "TABLE"
    spark.sql(f"DROP {kind} {_quoted(name)}")


def replace_table(spark: SparkSession, name: str, df: DataFrame) -> int | None:
    """Create or replace a table and return its row count.

    The rows are written aside as a version of their own and counted by the write itself;
    then one catalog call points the name, a view, at the new version. A reader sees the
    old rows or the new ones, whenever the write ends or fails. The version before stays
    for readers that have begun with it until the next replacement. An empty source without columns drops the name and
    its versions instead and returns None.
    """
    exists = spark.catalog.tableExists(_quoted(name))
    if not df.columns:
        if exists:
            _drop(spark, name)
        for version in _versions(spark, name):
            _drop(spark, version)
        return None
    version, before = f"{name.lower()}{_VERSION}{uuid.uuid4().hex}", None
    if exists and spark.catalog.getTable(_quoted(name)).tableType != "VIEW":
        # a plain table becomes the version before
        before = f"{name.lower()}{_VERSION}{uuid.uuid4().hex}"
        spark.sql(f"ALTER TABLE {_quoted(name)} RENAME TO {_quoted(before)}")
        _point(spark, name, before)
    elif exists:
        found = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)} ('version')").first()
        before = found["value"]
    written = Observation(version)
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.saveAsTable(_quoted(version))
    _point(spark, name, version)
    for old in _versions(spark, name):
        if old not in (version, before):
            _drop(spark, old)
    return written.get["rows"]


def _point(spark: SparkSession, name: str, version: str) -> None:
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ('version' = '{version}') AS SELECT * FROM {_quoted(version)}"
    )


def archive(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Keep a raw copy as parquet or JSON lines."""
    df.write.mode("overwrite").format(kind).save(path)
    return path


def q(spark: SparkSession, sql: str, params: Sequence | None = None) -> DataFrame:
    """Read-only query with ``?`` markers; anything but a query is refused.

    The text is read as a subquery, where the grammar has no command: an insert behind a
    WITH clause is a syntax error there and nothing of it runs.
    """
    text = sql.strip().rstrip(";")
    if not text:
        raise ValueError("the query is empty")
    try:
        return spark.sql(f"SELECT * FROM (\n{text}\n)", args=list(params or []))
    except ParseException as error:
        raise ValueError("only queries are allowed") from error


def layer_of(name: str, prefixes: Sequence[str] = SILVER_PREFIXES) -> str:
    return "silver" if name.startswith(tuple(prefixes)) else "gold"


def tables(
    spark: SparkSession, layer: str | None = None, prefixes: Sequence[str] = SILVER_PREFIXES
) -> DataFrame:
    """table, layer and exact row count of every table or view, versions of them left out."""
    names = sorted(t.name for t in spark.catalog.listTables() if _VERSION not in t.name)
    wanted = [n for n in names if layer is None or layer_of(n, prefixes) == layer]
    if not wanted:
        return spark.createDataFrame([], "table string, layer string, rows bigint")
    out = None
    for name in wanted:
        one = spark.table(_quoted(name)).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(layer_of(name, prefixes)).alias("layer"), "rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


def columns(spark: SparkSession, table: str) -> DataFrame:
    """column_name and data_type in declared order."""
    found = [(c.name, c.dataType) for c in spark.catalog.listColumns(_quoted(table))]
    return spark.createDataFrame(found, "column_name string, data_type string")


def peek(spark: SparkSession, table: str, n: int = 5) -> DataFrame:
    """The first few rows of a table."""
    return spark.table(_quoted(table)).limit(int(n))


def summarize(listing: DataFrame, brief: bool = False) -> DataFrame:
    """Tables and rows per layer, or the whole listing in order."""
    if brief:
        return listing.groupBy("layer").agg(
            F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows")
        )
    return listing.orderBy(F.col("layer").desc(), "table")
