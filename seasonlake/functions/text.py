"""Text keys and parsers as native column expressions (no Python worker)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from seasonlake.functions import fixed_values as fixed


def name_key(name: Column) -> Column:
    """Join key of a person's name: case, punctuation, one suffix and spacing removed."""
    bare = F.regexp_replace(F.lower(name), fixed.NAME_PUNCTUATION, "")
    bare = F.regexp_replace(bare, fixed.NAME_SUFFIX, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


def canonical_code(
    value: Column,
    codes: Mapping[str, str] = fixed.TEAM_CODES,
    aliases: Mapping[str, str] = fixed.TEAM_ALIASES,
    unit_marker: str = "D/ST",
) -> Column:
    """One code per team from an alias, a code, a nickname or a full name."""
    text = F.trim(value)
    upper = F.upper(text)
    known = F.when(upper.isin(*sorted(set(codes.values()))), upper)
    words = F.split(F.trim(F.replace(text, F.lit(unit_marker), F.lit(""))), r"\s+")
    return F.coalesce(_lookup(aliases, upper), known, _lookup(codes, F.element_at(words, -1)), upper)


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def packed_name(text: Column) -> Column:
    """``Name  TEAM (bye)`` -> struct(name, team, bye); team and bye may be absent."""
    return F.struct(
        _group(text, fixed.PACKED_NAME, 1).alias("name"),
        _group(text, fixed.PACKED_NAME, 2).alias("team"),
        _group(text, fixed.PACKED_NAME, 3).cast("long").alias("bye"),
    )


def letters_rank(text: Column) -> Column:
    """``RB12`` -> struct(position, position_rank); the rank may be absent."""
    return F.struct(
        _group(text, fixed.LETTERS_RANK, 1).alias("position"),
        _group(text, fixed.LETTERS_RANK, 2).cast("long").alias("position_rank"),
    )


def path_token(url: Column, before: str, token: str = r"[^/?#\"]+") -> Column:
    """The path segment after ``before`` (an id or a code), NULL when absent."""
    return _group(url, f"/{before}/({token})", 1)


def parse_number(text: Column) -> Column:
    """Number with thousands commas; anything else is NULL."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def tagged_stem(file_name: Column, prefix: str) -> Column:
    """``adp_half-ppr_2020.json`` -> struct(tag, season), split at the last underscore."""
    pattern = rf"^{prefix}_(.*)_(\d+)\.[^.]*$"
    return F.struct(
        _group(file_name, pattern, 1).alias("tag"),
        _group(file_name, pattern, 2).cast("long").alias("season"),
    )


def snapshot_season(stamp: Column) -> Column:
    """Season of an ISO stamp: its year, one less before July."""
    year = F.substring(stamp, 1, 4).try_cast("long")
    month = F.substring(stamp, 6, 2).try_cast("long")
    return year - F.when(month < 7, 1).otherwise(0)


def label_count(label: Column, position: str) -> Column:
    """The digit before ``position`` in a composition label, 0 when absent."""
    digit = F.regexp_extract(label, rf"(\d){position}", 1)
    return F.coalesce(digit.try_cast("long"), F.lit(0).cast("long"))


def composition_label(counts: Sequence[tuple[str, Column]]) -> Column:
    """``2RB2WR1TE`` from counts in the given order, zeros left out."""
    parts = [
        F.when(count > 0, F.concat(count.cast("string"), F.lit(name))).otherwise(F.lit(""))
        for name, count in counts
    ]
    return F.concat(*parts)


def year_of(text: Column) -> Column:
    """Year of an ISO date text, NULL when it is not a date."""
    return F.year(text.try_cast("date"))
