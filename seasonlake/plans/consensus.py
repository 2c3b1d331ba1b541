"""Consensus of sources and priced lists."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions.stats import blend_two, cap_at, floor_at, mean_of, one_hot
from seasonlake.functions.text import canonical_code, name_key
from seasonlake.operators.blend import (
    consensus, crosswalk, latest_shared_season, reject_ambiguous, two_source_blend,
)
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import ENT, O
from seasonlake.plans.registry import query

SOURCES = {
    "urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM",
    "unspecified": "4-NOT SPECIFIED", "low": "5-LOW",
}
CODES = "CASE o_orderpriority " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in SOURCES.items()) + " END"


def source_rows(t: Tables) -> DataFrame:
    """(entity, season, source): one exact number per source."""
    name = None
    for key, text in SOURCES.items():
        hit = F.col("source") == text
        name = F.when(hit, key) if name is None else name.when(hit, key)
    return t.orders().withColumn("source", name).groupBy("entity_id", "season", "source").agg(
        F.sum("points_c").alias("points_c")
    )


_STATS = """count(*) AS num_sources, round(min(points_c) / 100.0, 6) AS min_points,
  round(max(points_c) / 100.0, 6) AS max_points,
  round(quantile_cont(points_c, 0.2) / 100.0, 6) AS floor_p20,
  round(quantile_cont(points_c, 0.5) / 100.0, 6) AS median_p50,
  round(quantile_cont(points_c, 0.8) / 100.0, 6) AS ceiling_p80,
  round(stddev_samp(points_c) / 100.0, 4) AS stddev_points, """ + ", ".join(
    f"round(max(points_c) FILTER (WHERE source = '{s}') / 100.0, 6) AS {s}_points" for s in SOURCES
)
_SRC = f"""src AS (
  SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS BIGINT) AS season, {CODES} AS source,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS points_c
  FROM orders GROUP BY ALL)"""


def _rounded(df: DataFrame) -> DataFrame:
    digits = {c: 6 for c, kind in df.dtypes if kind == "double"} | {"stddev_points": 4}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


@query(
    "source_consensus",
    f"""WITH {_SRC}, {ENT},
    w AS (SELECT entity_id, source, points_c FROM src WHERE season = (SELECT max(season) FROM src))
    SELECT entity_id, min(entity_name) AS entity_name, min(position) AS position, {_STATS}
    FROM w JOIN ent USING (entity_id) GROUP BY entity_id""",
)
def source_consensus(t: Tables) -> DataFrame:
    """Five sources of one season's number per entity."""
    rows = source_rows(t).where(F.col("season") == t.newest_season())
    blended = consensus(rows, ("entity_id",), "points_c", list(SOURCES), scale=100.0)
    named = blended.join(t.entities().select("entity_id", "entity_name", "position"), "entity_id")
    return _rounded(named)


@query(
    "team_consensus",
    f"""WITH {_SRC}, {ENT},
    t AS (SELECT upper(team) AS team, season, source, sum(points_c) AS points_c
          FROM src JOIN ent USING (entity_id) GROUP BY 1, 2, 3)
    SELECT team, season, {_STATS} FROM t GROUP BY team, season""",
)
def team_consensus(t: Tables) -> DataFrame:
    """The same consensus keyed by canonical team code."""
    rows = source_rows(t).join(t.entities().select("entity_id", "team"), "entity_id")
    rows = rows.withColumn("team", canonical_code(F.col("team")))
    rows = rows.groupBy("team", "season", "source").agg(F.sum("points_c").alias("points_c"))
    return _rounded(consensus(rows, ("team", "season"), "points_c", list(SOURCES), scale=100.0))


_PRICED = f"""{O},
  a AS (SELECT entity_id, season, round(sum(points_c) * 1.0 / count(*), 6) AS urgent_price
        FROM o WHERE source = '1-URGENT' GROUP BY ALL),
  b AS (SELECT entity_id, season,
          round(sum(points_c) FILTER (WHERE source = '2-HIGH') * 1.0 / count(*) FILTER (WHERE source = '2-HIGH'), 6) AS high_price,
          round(sum(points_c) FILTER (WHERE source = '3-MEDIUM') * 1.0 / count(*) FILTER (WHERE source = '3-MEDIUM'), 6) AS medium_price,
          round(sum(points_c) FILTER (WHERE source = '5-LOW') * 1.0 / count(*) FILTER (WHERE source = '5-LOW'), 6) AS low_price
        FROM o WHERE source IN ('2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY ALL),
  priced AS (
    SELECT COALESCE(a.entity_id, b.entity_id) AS entity_id, COALESCE(a.season, b.season) AS season,
      urgent_price, high_price, medium_price, low_price,
      CASE WHEN urgent_price IS NOT NULL AND high_price IS NOT NULL THEN (urgent_price + high_price) / 2
           ELSE COALESCE(urgent_price, high_price) END AS price,
      CAST(urgent_price IS NOT NULL AS INT) + CAST(high_price IS NOT NULL AS INT) AS num_sources
    FROM a FULL OUTER JOIN b ON a.entity_id = b.entity_id AND a.season = b.season)"""


FORMATS = {"high_price": "2-HIGH", "medium_price": "3-MEDIUM", "low_price": "5-LOW"}


def _mean_of_source(source: str):
    hit = F.col("source") == source
    mean = F.sum(F.when(hit, F.col("points_c"))) / F.nullif(F.count_if(hit), F.lit(0))
    return F.round(mean, 6)


def priced(t: Tables) -> DataFrame:
    """Price per (entity, season): two voting lists, two more kept as columns.

    All four lists come from one file here, so one aggregation reads it once; the
    two-feed form of the same table is the ``two_source_blend`` query.
    """
    o = t.orders().where(F.col("source").isin("1-URGENT", *FORMATS.values()))
    wide = o.groupBy("entity_id", "season").agg(
        _mean_of_source("1-URGENT").alias("urgent_price"),
        *[_mean_of_source(s).alias(n) for n, s in FORMATS.items()],
    )
    a, b = F.col("urgent_price"), F.col("high_price")
    return wide.withColumn("price", blend_two(a, b)).withColumn(
        "num_sources", a.isNotNull().cast("int") + b.isNotNull().cast("int")
    )


@query("two_source_blend", f"WITH {_PRICED} SELECT * FROM priced")
def two_source_blend_query(t: Tables) -> DataFrame:
    """Two feeds full-outer joined; formats that do not vote stay as columns."""
    o = t.orders().select("entity_id", "season", "source", "points_c")
    keys = ["entity_id", "season"]
    a = o.where(F.col("source") == "1-URGENT").groupBy(*keys).agg(_mean_of_source("1-URGENT").alias("urgent_price"))
    b = o.where(F.col("source").isin(*FORMATS.values())).groupBy(*keys).agg(
        *[_mean_of_source(s).alias(n) for n, s in FORMATS.items()]
    )
    return two_source_blend(a, b, keys, "urgent_price", "high_price", "price")


@query(
    "current_season_arm",
    f"""WITH {O}, feeds AS (
      SELECT max(season) AS season FROM o WHERE source = '1-URGENT' UNION ALL
      SELECT max(TRY_CAST(CAST(season AS VARCHAR) AS BIGINT)) FROM o WHERE source = '2-HIGH' UNION ALL
      SELECT max(season) FROM o WHERE source = '3-MEDIUM' AND week <= 6),
    cur AS (SELECT max(season) AS season FROM feeds),
    inhouse AS (SELECT entity_id, season, source, points_c FROM o WHERE source = '5-LOW'),
    arm AS (SELECT entity_id, season, CASE WHEN source = '5-LOW' THEN 'L' ELSE source END AS code, points_c
            FROM inhouse WHERE season = (SELECT season FROM cur))
    SELECT a.entity_id, a.season, code, count(*) AS n, CAST(sum(points_c) AS BIGINT) AS points_c
    FROM arm a JOIN customer c ON TRY_CAST(CAST(a.entity_id AS VARCHAR) AS DOUBLE) = CAST(c.c_custkey AS DOUBLE)
    GROUP BY ALL""",
)
def current_season_arm(t: Tables) -> DataFrame:
    """One source kept only at the newest season of the other feeds; text key cast to join."""
    o = t.orders().select("entity_id", "season", "week", "source", "points_c")
    feeds = [
        o.where(F.col("source") == "1-URGENT"),
        o.where(F.col("source") == "2-HIGH").withColumn("season", F.col("season").cast("string")),
        o.where((F.col("source") == "3-MEDIUM") & (F.col("week") <= 6)),
    ]
    current = latest_shared_season(feeds)
    arm = o.where(F.col("source") == "5-LOW").join(current, "season", "left_semi")
    arm = arm.withColumn("code", F.when(F.col("source") == "5-LOW", "L").otherwise(F.col("source")))
    arm = arm.groupBy("entity_id", "season", "code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points_c").alias("points_c")
    )
    keyed = arm.withColumn("text_id", F.col("entity_id").cast("string"))
    ids = t.raw("customer").select(F.col("c_custkey").cast("double").alias("key"))
    return keyed.join(ids, keyed.text_id.try_cast("double") == ids.key).select(
        "entity_id", "season", "code", "n", "points_c"
    )


@query(
    "row_blend",
    f"""WITH {_PRICED}, {ENT}
    SELECT entity_id, season,
      round(CASE WHEN (urgent_price IS NOT NULL)::INT + (low_price IS NOT NULL)::INT = 0 THEN NULL
        ELSE (COALESCE(urgent_price, 0.0) + COALESCE(low_price, 0.0))
           / ((urgent_price IS NOT NULL)::INT + (low_price IS NOT NULL)::INT) END, 6) AS mean_price,
      CASE WHEN price IS NOT NULL THEN greatest(price - 20000000.0, 0.0) END AS above_floor,
      CASE WHEN price IS NOT NULL THEN least(price / 30000000.0, 1.0) END AS capped_ratio,
      CAST(position = 'AUTOMOBILE' AS INT) AS seg_AUTOMOBILE, CAST(position = 'BUILDING' AS INT) AS seg_BUILDING,
      CAST(position = 'MISSING' AS INT) AS seg_MISSING,
      nullif(num_sources, 0) AS voting_sources, COALESCE(low_price, medium_price, price) AS first_price
    FROM priced JOIN ent USING (entity_id)""",
)
def row_blend(t: Tables) -> DataFrame:
    """Row-wise mean, floor, cap, one-hot, nullif and coalesce."""
    df = priced(t).join(t.entities().select("entity_id", "position"), "entity_id")
    return df.select(
        "entity_id", "season",
        F.round(mean_of([F.col("urgent_price"), F.col("low_price")]), 6).alias("mean_price"),
        floor_at(F.col("price") - 20000000.0, 0.0).alias("above_floor"),
        cap_at(F.col("price") / 30000000.0, 1.0).alias("capped_ratio"),
        *one_hot(F.col("position"), ("AUTOMOBILE", "BUILDING", "MISSING"), "seg"),
        F.nullif(F.col("num_sources"), F.lit(0)).alias("voting_sources"),
        F.coalesce("low_price", "medium_price", "price").alias("first_price"),
    )


_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[.''’]', '', 'g'),
  '\s+(jr|sr|ii|iii|iv|v)\.?$', ''), '\s+', ' ', 'g'))"""


@query(
    "computed_key_join",
    f"""WITH feed AS (
      SELECT o_orderkey AS order_id, c_mktsegment AS position, CAST(round(o_totalprice * 100) AS BIGINT) AS points_c,
             CASE o_orderkey % 3 WHEN 0 THEN upper(c_name) || ' Jr.' WHEN 1 THEN 'O''' || c_name || '  III'
                  ELSE c_name END AS raw_name
      FROM orders JOIN customer ON c_custkey = o_custkey),
    ids AS (SELECT {_KEY.format("c_name")} AS merge_name, c_mktsegment AS position, min(c_custkey) AS entity_id
            FROM customer GROUP BY 1, 2 HAVING min(c_custkey) = max(c_custkey))
    SELECT entity_id, ids.position, count(*) AS n, CAST(sum(points_c) AS BIGINT) AS points_c
    FROM feed JOIN ids ON ids.merge_name = {_KEY.format("raw_name")} AND ids.position = feed.position
    GROUP BY ALL""",
)
def computed_key_join(t: Tables) -> DataFrame:
    """Free-text names joined to the id dimension by their normalised key and position."""
    customer = t.raw("customer").select(
        F.col("c_custkey").alias("entity_id"), "c_name", F.col("c_mktsegment").alias("position")
    )
    text = (
        F.when(F.col("order_id") % 3 == 0, F.concat(F.upper("c_name"), F.lit(" Jr.")))
        .when(F.col("order_id") % 3 == 1, F.concat(F.lit("O'"), F.col("c_name"), F.lit("  III")))
        .otherwise(F.col("c_name"))
    )
    feed = (
        t.orders().select("order_id", "entity_id", "points_c").join(customer, "entity_id")
        .select("position", "points_c", name_key(text).alias("raw_key"))
        # one row per key before the join: a hot name becomes a single row
        .groupBy("position", "raw_key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("points_c").alias("points_c"))
    )
    ids = reject_ambiguous(
        customer.withColumn("merge_name", name_key(F.col("c_name"))),
        ("merge_name", "position"), "entity_id",
    )
    joined = crosswalk(feed, ids, F.col("raw_key"), F.col("merge_name"))
    return joined.groupBy("entity_id", "position").agg(
        F.sum("n").alias("n"), F.sum("points_c").alias("points_c")
    )
