"""Nested JSON: flattening, map-of-records, first match, counts and id lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def flatten_structs(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every nested struct field becomes a column named by its path; lists stay lists."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    columns = [
        F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))
        for path in leaves(df.schema, ())
    ]
    return df.select(*columns)


def map_of_records(df: DataFrame, text: str, record_schema: str) -> DataFrame:
    """``{id: {..}, ..}`` text -> one row per record."""
    parsed = F.from_json(F.col(text), f"map<string,{record_schema}>")
    return df.select(F.explode(F.map_values(parsed)).alias("r")).select("r.*")


def first_match(items: Column, predicate: Callable[[Column], Column]) -> Column:
    """First array element that satisfies ``predicate``; NULL when none does."""
    return F.try_element_at(F.filter(items, predicate), F.lit(1))


def count_value(items: Column, value: str) -> Column:
    """How often ``value`` occurs in an array; 0 for a missing array."""
    hits = F.size(F.filter(items, lambda x: x == value))
    return F.coalesce(F.when(items.isNotNull(), hits), F.lit(0)).cast("long")


def points_by_id(items: Column, ids: Mapping[str, int], key: str = "statId", value: str = "points") -> list[Column]:
    """array<struct(id, points)> -> one column per wanted id, absent ids 0.0."""

    def priced(wanted: int) -> Column:
        return first_match(items, lambda item: item[key] == wanted)[value]

    return [
        F.coalesce(priced(wanted), F.lit(0.0)).cast("double").alias(name)
        for name, wanted in ids.items()
    ]


def literal_items(text: Column, schema: str = "array<struct<statId:bigint,points:double>>") -> Column:
    """Parse a list of records written with single quotes."""
    return F.from_json(text, schema, {"allowSingleQuotes": "true"})


def slot_counts(slots: Column, ids: Mapping[str, str]) -> list[Column]:
    """map<slot id, count> -> one column per slot name."""
    return [
        F.coalesce(F.try_element_at(slots, F.lit(slot)), F.lit(0)).cast("long").alias(name)
        for name, slot in ids.items()
    ]
