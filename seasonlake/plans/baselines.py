"""History queries: baselines, fallback rates, cohorts and stability."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.operators.history import (
    before_season, prior_counters, recency_baseline, stability_table, year_pairs,
)
from seasonlake.operators.ranking import with_position
from seasonlake.operators.rates import luck_neutral, rate_with_fallback
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import BASE, ENT, L, O, TOT
from seasonlake.plans.registry import query
from seasonlake.session import pinned

MIN_GAMES = 2


def season_metrics(t: Tables) -> DataFrame:
    """Season rows with per-game numbers in whole cents; no urgent orders, no urgent mean."""
    urgent = F.when(F.col("source") == "1-URGENT", F.col("points_c"))
    return t.orders().groupBy("entity_id", "season").agg(
        F.count(F.lit(1)).alias("games"),
        F.round(F.sum("points_c") / F.count(F.lit(1))).cast("long").alias("ppg"),
        F.avg((F.col("source") == "2-HIGH").cast("double")).alias("high_share"),
        F.round(F.sum(urgent) / F.nullif(F.count(urgent), F.lit(0))).cast("long").alias("urgent_mean"),
    )


METRICS = """m AS (
  SELECT entity_id, season, count(*) AS games, CAST(round(sum(points_c) / count(*)) AS BIGINT) AS ppg,
         avg(CAST(source = '2-HIGH' AS DOUBLE)) AS high_share,
         CAST(round(sum(points_c) FILTER (WHERE source = '1-URGENT')
           / nullif(count(*) FILTER (WHERE source = '1-URGENT'), 0)) AS BIGINT) AS urgent_mean
  FROM o GROUP BY entity_id, season)"""
BASELINE = f"""{METRICS},
  ts AS (SELECT unnest(generate_series(min(season) + 1, max(season) + 1)) AS target_season
         FROM m WHERE games >= {MIN_GAMES}),
  h AS (SELECT target_season, m.*, 11 - (target_season - season) AS w FROM ts JOIN m
        ON m.season < target_season AND target_season - m.season <= 4 WHERE games >= {MIN_GAMES}),
  bl AS (
    SELECT target_season, entity_id, count(*) AS seasons_used, CAST(sum(games) AS BIGINT) AS games_used,
      round(sum(ppg * w) / sum(w), 4) AS weighted_ppg,
      round(sum(high_share * w) / sum(w), 6) AS weighted_high_share,
      round(sum(urgent_mean * w) / sum(w) FILTER (WHERE urgent_mean IS NOT NULL), 4) AS weighted_urgent_mean,
      round(sum(games * w) * 1.0 / sum(w), 6) AS weighted_games_per_season
    FROM h GROUP BY target_season, entity_id)"""


def baseline(t: Tables, metrics: DataFrame | None = None) -> DataFrame:
    """Look-back rows over ``metrics``, the season rows of ``t`` if not given."""
    df = recency_baseline(
        season_metrics(t) if metrics is None else metrics, ("ppg", "high_share", "urgent_mean"), min_games=MIN_GAMES
    )
    digits = {"weighted_ppg": 4, "weighted_urgent_mean": 4, "weighted_high_share": 6,
              "weighted_games_per_season": 6}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


@query(
    "recency_baseline",
    f"""WITH {O}, {ENT}, {BASELINE}
    SELECT bl.*, entity_name, position FROM bl JOIN ent USING (entity_id)""",
)
def recency_baseline_query(t: Tables) -> DataFrame:
    """Four-season look-back, weights 1.0 / 0.9 / 0.8 / 0.7, NULL-aware per metric."""
    names = t.entities().select("entity_id", "entity_name", "position")
    return baseline(t).join(names, "entity_id")


MIN_UNITS = 30000


def entity_lines(t: Tables) -> DataFrame:
    """(season, entity): orders, points, units, returned units from one line scan."""
    lines = t.lines().select(
        "order_id", "units", F.when(F.col("return_flag") == "R", F.col("units")).alias("returned")
    )
    per_order = lines.groupBy("order_id").agg(
        F.sum("units").alias("units"), F.coalesce(F.sum("returned"), F.lit(0)).alias("returned")
    )
    orders = t.orders().select("order_id", "entity_id", "season", "points_c")
    return orders.join(per_order, "order_id").groupBy("entity_id", "season").agg(
        F.count(F.lit(1)).alias("games"), F.sum("points_c").alias("points_c"),
        F.sum("units").alias("units"), F.sum("returned").alias("returned"),
    )


@query(
    "rate_fallback",
    f"""WITH {O}, {ENT}, {L},
    e AS (SELECT entity_id, o.season, count(DISTINCT order_id) AS games,
                 CAST(sum(units) AS BIGINT) AS units,
                 CAST(COALESCE(sum(units) FILTER (WHERE return_flag = 'R'), 0) AS BIGINT) AS returned
          FROM l JOIN o USING (order_id) GROUP BY ALL),
    p AS (SELECT entity_id, season, CAST(sum(points_c) AS BIGINT) AS points_c FROM o
          WHERE order_id IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL),
    x AS (SELECT e.*, points_c, position FROM e JOIN p USING (entity_id, season) JOIN ent USING (entity_id)),
    pooled AS (SELECT season, sum(returned) * 1.0 / nullif(sum(units), 0) AS r FROM x GROUP BY season),
    rates AS (
      SELECT x.season, position, COALESCE(CASE WHEN sum(units) >= {MIN_UNITS}
               THEN sum(returned) * 1.0 / nullif(sum(units), 0) END, any_value(r)) AS return_rate
      FROM x JOIN pooled ON pooled.season = x.season GROUP BY x.season, position)
    SELECT entity_id, x.season, x.position, round(return_rate, 8) AS return_rate,
           round((points_c - 5000 * returned + 5000 * units * return_rate) / games, 4) AS neutral_ppg
    FROM x JOIN rates ON rates.season = x.season AND rates.position = x.position""",
)
def rate_fallback(t: Tables) -> DataFrame:
    """Return rate per season and position, pooled when thin; luck-neutral points."""
    # the lines are read once; the season table serves the rates and the rows
    seasons = pinned(entity_lines(t).join(t.entities().select("entity_id", "position"), "entity_id"))
    rates = rate_with_fallback(
        seasons, ("season",), ("position",), {"return_rate": ("returned", "units")}, MIN_UNITS
    )
    joined = seasons.join(rates, ["season", "position"])
    neutral = luck_neutral(
        F.col("points_c"), [(5000, F.col("returned"), F.col("units"), F.col("return_rate"))]
    )
    return joined.select(
        "entity_id", "season", "position", F.round("return_rate", 8).alias("return_rate"),
        F.round(neutral / F.col("games"), 4).alias("neutral_ppg"),
    )


@query(
    "no_history_cohort",
    f"""WITH {O}, {ENT}, {TOT}, {BASELINE},
    career AS (
      SELECT t.entity_id, t.season, sum(p.points_c) * 1.0 / sum(p.games) AS career_ppg,
             CAST(sum(p.games) AS BIGINT) AS career_games
      FROM tot t JOIN tot p ON p.entity_id = t.entity_id AND p.season < t.season GROUP BY ALL)
    SELECT tot.entity_id, tot.season AS target_season, position, round(career_ppg, 4) AS career_ppg,
           career_games, tot.games AS actual_games
    FROM tot JOIN ent USING (entity_id)
    LEFT JOIN career c ON c.entity_id = tot.entity_id AND c.season = tot.season
    LEFT JOIN bl ON bl.entity_id = tot.entity_id AND bl.target_season = tot.season
    WHERE bl.entity_id IS NULL""",
)
def no_history_cohort(t: Tables) -> DataFrame:
    """Active entities the baseline cannot see, with their unweighted career so far."""
    totals = t.totals()
    earlier = before_season(["entity_id"])
    roster = totals.select(
        "entity_id",
        F.col("season").alias("target_season"),
        (F.sum("points_c").over(earlier) / F.sum("games").over(earlier)).alias("career_ppg"),
        F.sum("games").over(earlier).alias("career_games"),
        F.col("games").alias("actual_games"),
    )
    cohort = roster.join(baseline(t), ["entity_id", "target_season"], "left_anti")
    named = cohort.join(t.entities().select("entity_id", "position"), "entity_id")
    return named.withColumn("career_ppg", F.round("career_ppg", 4))


ELITE = 30


def elite_seasons(t: Tables) -> DataFrame:
    """Season totals with position rank and the elite flag."""
    ranked = with_position(t.season_totals(), ("season", "position"), "points_c", "entity_id")
    return ranked.withColumn("is_elite", F.col("position_rank") <= ELITE)


@query(
    "prior_counters",
    f"""{BASE},
    e AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY points_c DESC, entity_id) AS position_rank FROM st),
    f AS (SELECT *, position_rank <= {ELITE} AS is_elite FROM e)
    SELECT f.entity_id, f.season, f.position_rank, f.is_elite, count(b.season) AS prior_seasons,
           CAST(COALESCE(sum(CASE WHEN b.is_elite THEN 1 ELSE 0 END), 0) AS BIGINT) AS prior_elite,
           max(CASE WHEN b.season = f.season - 1 AND b.is_elite THEN 1 ELSE 0 END) AS elite_last_season
    FROM f LEFT JOIN f b ON b.entity_id = f.entity_id AND b.season < f.season
    GROUP BY ALL""",
)
def prior_counters_query(t: Tables) -> DataFrame:
    """Elite finishes strictly before the season, and in the season before."""
    return prior_counters(elite_seasons(t), ["entity_id"], F.col("is_elite")).select(
        "entity_id", "season", "position_rank", "is_elite", "prior_seasons", "prior_elite",
        "elite_last_season",
    )


STATS = ("points_c", "games", "ppg", "high_share")


@query(
    "yoy_stability",
    f"""WITH {O}, {METRICS}, f AS (SELECT *, ppg * games AS points_c FROM m WHERE games >= 2),
    p AS (SELECT a.points_c, b.points_c AS points_c_next, a.games, b.games AS games_next, a.ppg, b.ppg AS ppg_next,
                 a.high_share, b.high_share AS high_share_next
          FROM f a JOIN f b ON b.entity_id = a.entity_id AND b.season = a.season + 1)
    SELECT count(*) AS pairs, 'points_c' AS stat, round(corr(points_c, points_c_next), 6) AS r FROM p UNION ALL
    SELECT count(*), 'games', round(corr(games, games_next), 6) FROM p UNION ALL
    SELECT count(*), 'ppg', round(corr(ppg, ppg_next), 6) FROM p UNION ALL
    SELECT count(*), 'high_share', round(corr(high_share, high_share_next), 6) FROM p""",
)
def yoy_stability(t: Tables) -> DataFrame:
    """Correlation of each metric with the same entity's next season."""
    full = season_metrics(t).where(F.col("games") >= 2).withColumn(
        "points_c", F.col("ppg") * F.col("games")
    )
    pairs = year_pairs(full, ["entity_id"], STATS)
    return stability_table(pairs, STATS).withColumn("r", F.round("r", 6))


@query(
    "periods_per_season",
    f"""WITH {O}, {ENT},
    home AS (SELECT DISTINCT team, season, week FROM o JOIN ent USING (entity_id)),
    g AS (SELECT season, CAST(round(count(*) * 2.0 / count(DISTINCT team)) AS BIGINT) AS periods FROM home GROUP BY season),
    want AS (SELECT season FROM g UNION SELECT max(season) + 1 FROM g)
    SELECT want.season, COALESCE(g.periods, (SELECT arg_max(periods, season) FROM g)) AS periods
    FROM want LEFT JOIN g ON g.season = want.season""",
)
def periods_per_season(t: Tables) -> DataFrame:
    """Games per season from the calendar; an unscheduled season inherits the latest."""
    home = t.orders().select("entity_id", "season", "week").distinct()
    home = home.join(t.entities().select("entity_id", "team"), "entity_id")
    home = home.select("team", "season", "week").distinct()
    games = home.groupBy("season").agg(
        F.round(F.count(F.lit(1)) * 2.0 / F.countDistinct("team")).cast("long").alias("periods")
    )
    upcoming = games.agg(
        (F.max("season") + 1).alias("season"), F.max_by("periods", "season").alias("periods")
    )
    return games.unionByName(upcoming)
