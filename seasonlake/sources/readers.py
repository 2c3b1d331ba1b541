"""Readers for raw archives: parquet, JSON, CSV and pages with embedded JSON."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seasonlake.functions import fixed_values as fixed, nested, text


def seasons_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many parquet files as one table; columns are unioned by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def pruned(df: DataFrame, predicate: Column, columns: Sequence[str]) -> DataFrame:
    """Filter and projection that reach the parquet scan."""
    return df.where(predicate).select(*columns)


BROKEN = "_broken"


def _tolerant(spark: SparkSession):
    """A reader that keeps what it cannot parse as text in the column ``BROKEN``."""
    return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)


def _sound(df: DataFrame) -> DataFrame:
    """Rows that parsed, without ``BROKEN``.

    Spark refuses to read that column alone, so it is tested together with another one.
    """
    other = next(f.name for f in df.schema if f.name != BROKEN and f.dataType.typeName() not in ("map", "variant"))
    pair = F.struct(F.col(BROKEN), F.col(f"`{other}`"))
    return df.where(pair.eqNullSafe(F.struct(F.lit(None).cast("string").alias(BROKEN), F.col(f"`{other}`")))).drop(BROKEN)


def _with_broken(schema: T.StructType) -> T.StructType:
    return T.StructType([*[f for f in schema if f.name != BROKEN], T.StructField(BROKEN, T.StringType())])


def records_json(spark: SparkSession, path: str, schema=None, flatten: bool = True, keep_broken: bool = False) -> DataFrame:
    """JSON array (or one object) of nested records, flattened to dotted columns.

    A file that is no JSON gives no rows, or its text in ``BROKEN`` with ``keep_broken``.
    Without a schema the records are sampled for one first.
    """
    reader = _tolerant(spark).option("multiLine", "true")
    kind = reader.json(path).schema if schema is None else T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    df = _tolerant(spark).option("multiLine", "true").schema(_with_broken(kind)).json(path)
    df = df if keep_broken else _sound(df)
    return nested.flatten_structs(df) if flatten else df


def _tag_of(path: Column, prefix: str) -> tuple[Column, Column]:
    """Tag and season from ``<prefix>_<tag>_<season>``, a file or its folder."""
    pattern = rf"[/=]{prefix}_([^/]*)_(\d+)(?:\.[^/]*)?(?:/[^/]*)?$"
    tag = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    season = F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")).cast("long")
    return tag, season


def tagged_json(
    spark: SparkSession, glob: str, prefix: str, player_schema: str, items: str = "players"
) -> DataFrame:
    """One row per record of every file, stamped with the tag and season of its name.

    A file without ``items`` (an error reply) and one that is no JSON give no rows.
    """
    schema = T._parse_datatype_string(f"{items} array<{player_schema}>")
    df = _tolerant(spark).schema(_with_broken(schema)).option("multiLine", "true").json(glob)
    tag, season = _tag_of(F.col("_metadata.file_path"), prefix)
    df = _sound(df.select("*", tag.alias("scoring_format"), season.alias("season")))
    return df.select(F.explode(items).alias("r"), "scoring_format", "season").select("r.*", "scoring_format", "season")


def header_groups(spark: SparkSession, glob: str) -> dict[str, list[str]]:
    """Files by their first line; only names and headers come to the driver."""
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    firsts = lines.where(F.col("block") == 0).groupBy("path").agg(F.min_by("value", "at").alias("header"))
    out: dict[str, list[str]] = {}
    for row in firsts.orderBy("path").collect():
        out.setdefault(row["header"], []).append(row["path"])
    return out


def season_csv(spark: SparkSession, glob: str, name_pattern: str, keep_broken: bool = False) -> DataFrame | None:
    """CSV rankings of many seasons; the season is group 1 of the name of a file or its folder.

    Files may order their columns in their own way or lack some: files of one header are
    read together, by name. Files whose name does not match are left out; None when no
    file is left. A row of too many or too few fields is left out, or kept with its
    text in ``BROKEN``.
    """
    place = rf"[/=]{name_pattern}(?:/[^/]*)?$"
    parts = []
    for header, paths in header_groups(spark, glob).items():
        paths = [p for p in paths if re.search(place, unquote(p))]
        if not paths:
            continue
        names = next(csv.reader([header]))
        schema = _with_broken(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        # whole rows are parsed whatever is asked for, so that a broken one is always seen
        df = _tolerant(spark).schema(schema).option("header", "true").option("columnPruning", "false").csv(paths)
        season = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), place, 1).try_cast("long")
        df = df.withColumn("_season", season)
        df = df if keep_broken else _sound(df)
        for missing in {"Rank", "Player (Bye)", "POS", "AVG"} - set(names):
            df = df.withColumn(missing, F.lit(None).cast("string"))
        who, pos = text.packed_name(F.col("Player (Bye)")), text.letters_rank(F.col("POS"))
        df = df.withColumn("_who", who).withColumn("_pos", pos)
        parts.append(df.select(
            F.col("_season").alias("season"), F.col("Rank").try_cast("long").alias("rank"),
            "_who.name", "_who.team", "_who.bye", "_pos.position", "_pos.position_rank",
            F.col("AVG").try_cast("double").alias("adp"), *([BROKEN] if keep_broken else []),
        ))
    return reduce(DataFrame.unionByName, parts) if parts else None


def embedded_records(pages: DataFrame, html: str, variable: str, record_schema: str, items: str = "players"):
    """Records of ``var <variable> = {..};`` in a page; a page without it is an error."""
    pattern = fixed.EMBEDDED_JSON.format(name=variable)
    blob = F.nullif(F.regexp_extract(F.col(html), pattern, 1), F.lit(""))
    found = F.coalesce(blob, F.raise_error(F.lit(f"no {variable} in page")).cast("string"))
    parsed = F.from_json(found, f"{items} array<{record_schema}>")
    return pages.select(
        *[c for c in pages.columns if c != html], F.explode(parsed[items]).alias("r")
    ).select(*[c for c in pages.columns if c != html], "r.*")


def stamped(arms: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of feeds, each stamped with its key."""
    out = None
    for value, df in arms.items():
        arm = df.withColumn(key, F.lit(value))
        out = arm if out is None else out.unionByName(arm, allowMissingColumns=True)
    return out


def coerced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; what is not a number, or was boolean, follows the cast."""
    kinds = dict(df.dtypes)
    made = {
        c: F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).try_cast("double")
        for c in columns
    }
    return df.withColumns(made)


def since(df: DataFrame, first: int, season: str = "season") -> DataFrame:
    """Coverage guard: seasons before the feed began are dropped."""
    return df.where(F.col(season) >= first)
