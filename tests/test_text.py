"""Text keys against small Python definitions of the same rules."""

import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from seasonlake.functions import fixed_values as fixed, text

NAMES = [
    "Odell Beckham Jr.", "Ken Walker III", "D'Andre Swift", "Ja’Marr Chase", "A.J.  Brown", "Patrick Mahomes II",
    "Robert Griffin V", "Vito Sr", "  Lead Space", "Irv Smith Jr", "V", "Mark Ingram ii.", "", "Jr Smith",
]
TEAMS = {
    "LAR": "LA", "Texans D/ST": "HOU", "Green Bay Packers": "GB", " oak ": "LV", "kc": "KC", "Jets": "NYJ",
    "San Francisco 49ers": "SF", "Unknown Club": "UNKNOWN CLUB", "WAS": "WAS", "sd": "LAC", "D/ST": "D/ST",
}


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def python_key(name):
    kept = "".join(c for c in name.lower() if c not in ".'’")
    words = re.split(r"(\s+)", kept)
    if len(words) >= 3 and words[-1] in ("jr", "sr", "ii", "iii", "iv", "v"):
        words = words[:-2]
    return " ".join("".join(words).split())


@pytest.mark.parametrize("name", NAMES)
def test_name_key(spark, name):
    assert one(spark, text.name_key(F.col("x")), name) == python_key(name)


@pytest.mark.parametrize("raw,code", TEAMS.items())
def test_canonical_code(spark, raw, code):
    assert one(spark, text.canonical_code(F.col("x")), raw) == code


def test_native_key_equals_a_python_udf(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(n,) for n in NAMES], "x string")
    udf = F.udf(python_key, "string")
    assert df.where(text.name_key(F.col("x")) != udf("x")).count() == 0


def test_null_stays_null(spark):
    assert one(spark, text.name_key(F.col("x")), None) is None
    assert one(spark, text.canonical_code(F.col("x")), None) is None
    assert one(spark, text.parse_number(F.col("x")), None) is None


@pytest.mark.parametrize("packed,parts", [
    ("Christian McCaffrey  SF (9)", ("Christian McCaffrey", "SF", 9)),
    ("Houston Texans  (14)", ("Houston Texans", None, 14)),
    ("Old Player", ("Old Player", None, None)),
    ("Amon-Ra St. Brown   DET (5)", ("Amon-Ra St. Brown", "DET", 5)),
])
def test_packed_name(spark, packed, parts):
    assert tuple(one(spark, text.packed_name(F.col("x")), packed)) == parts


@pytest.mark.parametrize("value,parts", [("RB12", ("RB", 12)), ("CB", ("CB", None)), ("DST1", ("DST", 1))])
def test_letters_rank(spark, value, parts):
    assert tuple(one(spark, text.letters_rank(F.col("x")), value)) == parts


def test_small_parsers(spark):
    assert one(spark, text.parse_number(F.col("x")), " 1,234.5 ") == 1234.5
    assert one(spark, text.parse_number(F.col("x")), "—") is None
    assert tuple(one(spark, text.tagged_stem(F.col("x"), "adp"), "adp_half-ppr_2020.json")) == ("half-ppr", 2020)
    assert one(spark, text.snapshot_season(F.col("x")), "2026-02-11T01:00Z") == 2025
    assert one(spark, text.snapshot_season(F.col("x")), "2025-07-01") == 2025
    assert one(spark, text.path_token(F.col("x"), "players", "[0-9]+"), "/nfl/players/42/a-b/") == "42"
    assert one(spark, text.label_count(F.col("x"), "RB"), "2RB3WR") == 2
    assert one(spark, text.label_count(F.col("x"), "TE"), "2RB3WR") == 0
    assert one(spark, text.year_of(F.col("x")), "1999-02-30") is None


def test_tables_are_consistent():
    codes = set(fixed.TEAM_CODES.values())
    assert len(codes) == 32
    assert set(fixed.TEAM_ALIASES.values()) <= codes
    assert not set(fixed.TEAM_ALIASES) & codes
