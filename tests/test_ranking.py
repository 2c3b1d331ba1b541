"""Distributed ranks against a plain sort, on skewed and awkward values."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seasonlake.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(6000):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}"
        kind = rng.random()
        value = (
            0.0 if kind < 0.4 else None if kind < 0.45
            else rng.uniform(-1e-4, 1e-4) if kind < 0.6
            else rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 12) if kind < 0.8
            else float(rng.randrange(-20, 20))
        )
        data.append((i, group, value))
    return spark.createDataFrame(data, "id long, g string, v double").cache()


@pytest.mark.parametrize("descending", [False, True])
def test_rank_family(skewed, as_rows, descending):
    v = F.col("v")
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    other = v.asc_nulls_first() if descending else v.desc_nulls_first()
    w = W.partitionBy("g")
    want = skewed.select(
        "id", F.rank().over(w.orderBy(order)).cast("long").alias("r"),
        F.percent_rank().over(w.orderBy(order)).alias("p"),
        F.percent_rank().over(w.orderBy(other)).alias("d"),
        (F.rank().over(w.orderBy(order)) + (F.count("*").over(W.partitionBy("g", "v")) - 1) / 2).alias("a"),
    )
    for bounded in (False, True):
        got = ranking.with_rank(
            skewed, ["g"], "v", descending, bounded=bounded, rank="r", percent_rank="p",
            percent_rank_desc="d", average_rank="a",
        ).select("id", "r", "p", "d", "a")
        assert as_rows(got, "id") == as_rows(want, "id")


def test_keep_null(skewed):
    out = ranking.with_rank(skewed, ["g"], "v", keep_null=True, rank="r", total="n")
    assert out.count() == skewed.count()
    assert out.where("v IS NULL AND r IS NOT NULL").count() == 0
    known = skewed.where("v IS NOT NULL AND g = 'hot'").count()
    assert out.where("g = 'hot' AND r IS NOT NULL").agg(F.max("n")).first()[0] == known


@pytest.mark.parametrize("descending", [False, True])
def test_position_and_tiles(skewed, as_rows, descending):
    v = F.col("v")
    order = [v.desc_nulls_last() if descending else v.asc_nulls_last(), F.col("id").asc()]
    w = W.partitionBy("g").orderBy(*order)
    want = skewed.select("id", F.row_number().over(w).cast("long").alias("p"), F.ntile(7).over(w).cast("long").alias("t"))
    got = ranking.with_position(skewed, ["g"], "v", "id", descending, name="p", total="n")
    got = got.withColumn("t", ranking.tile_of(F.col("p"), F.col("n"), 7)).select("id", "p", "t")
    assert as_rows(got, "id") == as_rows(want, "id")


@pytest.mark.parametrize("total", [1, 3, 6, 7, 8, 20])
def test_tiles_of_small_groups(spark, total):
    df = spark.range(1, total + 1).select(F.col("id").alias("p"), F.lit(total).alias("n"))
    got = [r[0] for r in df.orderBy("p").select(ranking.tile_of(F.col("p"), F.col("n"), 7)).collect()]
    want = [r[0] for r in df.select("p", F.ntile(7).over(W.partitionBy("n").orderBy("p")).alias("t")).orderBy("p").select("t").collect()]
    assert got == want


def test_percentiles_match_builtin(skewed, as_rows):
    points = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.8, "e": 1.0}
    got = as_rows(ranking.group_percentiles(skewed, ["g"], "v", points), "g")
    want = as_rows(skewed.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in points.items()]), "g")
    for x, y in zip(got, want):
        assert x["g"] == y["g"]
        for n in points:
            assert x[n] == pytest.approx(y[n], rel=1e-12, abs=1e-12)


def test_spearman_of_constant_is_null(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(9)] + [("b", i, float(-i), float(i)) for i in range(9)],
                               "g string, i long, x double, y double")
    got = {r["g"]: r["spearman"] for r in ranking.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(-1.0)


def test_top_k_never_gathers_a_group(skewed):
    out = ranking.top_k(skewed, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], 4)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("g").count().where("count <> 4").count() == 0


ODD = {
    "double": [-2.0, 1.0, 5.0, float("nan"), float("inf"), float("-inf"), None, 1.0, 0.0, 1e-9, 1e300, -1e300],
    "date": [None, *[datetime.date(1960 + 7 * i % 80, 1 + i % 12, 3) for i in range(30)]],
    "timestamp": [None, *[datetime.datetime(1960 + 7 * i % 80, 1 + i % 12, 3, i % 24) for i in range(30)]],
    "string": [None, "", "a", "ab", "abcdefghij", "abcdefghik", "b", "é", "zzz", "a", "~", " "],
}


@pytest.mark.parametrize("kind", list(ODD))
@pytest.mark.parametrize("descending", [False, True])
def test_odd_values_rank_as_the_window_does(spark, as_rows, kind, descending):
    rows = [(i, "g", v) for i, v in enumerate(ODD[kind])]
    df = spark.createDataFrame(rows, f"id long, g string, v {kind}")
    got, want = (
        as_rows(
            ranking.with_position(
                ranking.with_rank(df, ["g"], "v", descending, bounded=bounded, rank="r"), ["g"], "v", "id", descending,
                name="p", bounded=bounded,
            ).select("id", "r", "p"), "id",
        )
        for bounded in (False, True)
    )
    assert got == want


@pytest.mark.parametrize("kind", ["narrow", "one value", "one far value"])
def test_ranges_hold_even_shares(spark, kind):
    """No range holds more than three times its share, wherever the values crowd."""
    value = {
        "narrow": F.lit(1000.0) + F.col("id") * F.lit(1e-9),
        "one value": F.lit(7.0),
        "one far value": F.when(F.col("id") == 5, 1e12).otherwise(1000.0 + (F.col("id") % 100_000) * 1e-8),
    }[kind]
    rows = spark.range(1_000_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), value.alias("v"))
    with_conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in ranking.ranged(rows, ["g", F.col("v").desc(), "id"]).groupBy("_range").count().collect()]
        assert sum(sizes) == 1_000_000 and len(sizes) == 16 and max(sizes) < 3 * 1_000_000 / 16
        # the numbering over those ranges is whole
        placed = ranking.with_position(rows, ["g"], "v", "id", name="p", total="n").where("g = 'hot'")
        assert placed.agg(F.count_distinct("p"), F.min("p"), F.max("p"), F.max("n")).first() == (666_666, 1, 666_666, 666_666)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
