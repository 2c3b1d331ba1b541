"""Scoring, replacement level and outcome buckets over the driver tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seasonlake.operators.outcomes import outcome_buckets, played_role, price_ranks
from seasonlake.operators.ranking import with_position
from seasonlake.operators.replacement import (
    deepest_rank, points_over_replacement, replacement_levels,
)
from seasonlake.operators.settings import linear_points, with_settings
from seasonlake.plans.bindings import Tables
from seasonlake.plans.consensus import _PRICED, priced
from seasonlake.plans.leagues import FIELDS, FLEX, FLEX_POSITIONS, LG, POSITIONS, SETTINGS, SLOTS
from seasonlake.plans.oracle_parts import ENT, O
from seasonlake.plans.registry import query

DEPTH = deepest_rank(SETTINGS, SLOTS, FLEX)


def stat_lines(t: Tables) -> DataFrame:
    """(entity, season): spend by order status and counts of three priorities."""
    spent = [
        F.coalesce(F.sum(F.when(F.col("status") == s.upper(), F.col("points_c"))), F.lit(0)).alias(f"{s}_c")
        for s in "fop"
    ]
    counts = [
        F.count_if(F.col("source") == text).alias(name)
        for name, text in (("n_urgent", "1-URGENT"), ("n_high", "2-HIGH"), ("n_low", "5-LOW"))
    ]
    seasons = t.orders().groupBy("entity_id", "season").agg(
        F.count(F.lit(1)).alias("games_played"), F.sum("points_c").alias("points_c"), *spent, *counts
    )
    people = t.entities().where(F.col("position").isin(*POSITIONS))
    return seasons.join(people.select("entity_id", "entity_name", "position"), "entity_id")


def league_pool(t: Tables) -> DataFrame:
    """Stat lines priced under each league's settings."""
    pool = with_settings(t.gold("stat_lines", lambda: stat_lines(t)), SETTINGS, FIELDS)
    points = linear_points(
        {"f_c": "f_pts", "o_c": "o_pts", "p_c": "p_pts"}, ("n_urgent", "n_high", "n_low"), "miss_pts"
    )
    return pool.withColumn("league_points", points)


def over_replacement(t: Tables, keep: Sequence[str] | None = None) -> DataFrame:
    return points_over_replacement(league_pool(t), ("league_key", "season"), SLOTS, FLEX, DEPTH, keep=keep)


_SLOT_CASE = "CASE position " + " ".join(f"WHEN '{p}' THEN {c}" for p, c in SLOTS.items()) + " END"
_IN = "(" + ", ".join(f"'{p}'" for p in POSITIONS) + ")"
_FLEX_IN = "(" + ", ".join(f"'{p}'" for p in FLEX_POSITIONS) + ")"
POOL = f"""{LG},
  sl AS (
    SELECT entity_id, season, count(*) AS games_played, CAST(sum(points_c) AS BIGINT) AS points_c,
      COALESCE(sum(points_c) FILTER (WHERE status = 'F'), 0) AS f_c,
      COALESCE(sum(points_c) FILTER (WHERE status = 'O'), 0) AS o_c,
      COALESCE(sum(points_c) FILTER (WHERE status = 'P'), 0) AS p_c,
      count(*) FILTER (WHERE source = '1-URGENT') AS n_urgent,
      count(*) FILTER (WHERE source = '2-HIGH') AS n_high,
      count(*) FILTER (WHERE source = '5-LOW') AS n_low
    FROM o GROUP BY entity_id, season),
  pool AS (
    SELECT sl.*, entity_name, position, lg.*,
      f_c * f_pts + o_c * o_pts + p_c * p_pts + (n_urgent + n_high + n_low) * miss_pts AS league_points,
      team_count * {_SLOT_CASE} AS dedicated
    FROM sl JOIN ent USING (entity_id) CROSS JOIN lg WHERE position IN {_IN})"""
LEVELS = """{p}rk AS (
    SELECT *, row_number() OVER (PARTITION BY league_key, season, position
      ORDER BY league_points DESC, entity_id) AS position_rank FROM {pool}),
  {p}fx AS (SELECT *, row_number() OVER (PARTITION BY league_key, season ORDER BY league_points DESC, entity_id) AS frn
         FROM {p}rk WHERE position IN {flex} AND position_rank > dedicated),
  {p}won AS (SELECT league_key, season, position, count(*) AS won FROM {p}fx
          WHERE frn <= team_count * flex_slots GROUP BY ALL),
  {p}cells AS (SELECT league_key, season, position, any_value(dedicated) AS dedicated, count(*) AS n
            FROM {p}rk GROUP BY ALL),
  {p}lev AS (
    SELECT c.league_key, c.season, c.position, c.dedicated + COALESCE(won, 0) AS starters_at_position,
           r.league_points AS replacement_level_points
    FROM {p}cells c LEFT JOIN {p}won w USING (league_key, season, position)
    JOIN {p}rk r ON r.league_key = c.league_key AND r.season = c.season AND r.position = c.position
      AND r.position_rank = least(c.dedicated + COALESCE(won, 0) + 1, n))"""
POR = f"""{POOL}, {LEVELS.format(p='', pool='pool', flex=_FLEX_IN)},
  por AS (SELECT rk.*, starters_at_position, replacement_level_points,
                 league_points - replacement_level_points AS points_over_replacement
          FROM rk JOIN lev USING (league_key, season, position))"""


@query(
    "linear_scoring",
    f"""WITH {O}, {ENT}, {POOL}
    SELECT league_key, season, entity_id, position, league_points,
           row_number() OVER (PARTITION BY league_key, season, position ORDER BY league_points DESC, entity_id) AS position_rank
    FROM pool""",
)
def linear_scoring(t: Tables) -> DataFrame:
    """Points under each league's prices and the rank inside the position."""
    ranked = with_position(
        league_pool(t), ("league_key", "season", "position"), "league_points", "entity_id"
    )
    return ranked.select(
        "league_key", "season", "entity_id", "position", "league_points", "position_rank"
    )


@query(
    "replacement_level",
    f"""WITH {O}, {ENT}, {POR}
    SELECT league_key, season, position, starters_at_position, replacement_level_points FROM lev""",
)
def replacement_level(t: Tables) -> DataFrame:
    """Dedicated slots first, then one pool of flexible slots across positions."""
    return replacement_levels(league_pool(t), ("league_key", "season"), SLOTS, FLEX, DEPTH)


@query(
    "points_over_replacement",
    f"""WITH {O}, {ENT}, {POR}
    SELECT league_key, season, entity_id, entity_name, position, games_played, league_points, position_rank,
           starters_at_position, replacement_level_points, points_over_replacement FROM por""",
)
def points_over_replacement_query(t: Tables) -> DataFrame:
    return over_replacement(t).select(
        "league_key", "season", "entity_id", "entity_name", "position", "games_played",
        "league_points", "position_rank", "starters_at_position", "replacement_level_points",
        "points_over_replacement",
    )


def asking_prices(t: Tables) -> DataFrame:
    return t.gold("asking_prices", lambda: build_asking_prices(t))


def build_asking_prices(t: Tables) -> DataFrame:
    """What a season costs: last season's blended price, a low number being dear."""
    cost = priced(t).where(F.col("price").isNotNull()).select(
        "entity_id", (F.col("season") + 1).alias("season"),
        ((F.lit(50000000.0) - F.col("price")) / 100000.0).alias("price"),
    )
    people = t.entities().select("entity_id", "entity_name", "position")
    return cost.join(people, "entity_id")


ASKING = """ask AS (
    SELECT entity_id, entity_name, season + 1 AS season, position, (50000000.0::DOUBLE - price) / 100000.0 AS price
    FROM priced JOIN ent USING (entity_id) WHERE price IS NOT NULL)"""
CHART = """ch AS (SELECT entity_id, season, week, bool_or(source IN ('1-URGENT', '2-HIGH')) AS is_starter
    FROM o GROUP BY ALL),
  role AS (SELECT entity_id, season, avg(CASE WHEN is_starter THEN 1.0 ELSE 0.0 END) AS started FROM ch
    JOIN (SELECT DISTINCT entity_id, season, week FROM o WHERE status <> 'P') USING (entity_id, season, week)
    GROUP BY ALL)"""
MIN_GAMES = 4
BUCKETS = f"""pr AS (
    SELECT *, rank() OVER (PARTITION BY season, position ORDER BY price) AS price_rank,
           percent_rank() OVER (PARTITION BY season, position ORDER BY price DESC) AS preseason_percentile
    FROM ask),
  tr AS (
    SELECT por.*, price, price_rank, preseason_percentile,
           percent_rank() OVER (PARTITION BY league_key, por.season, por.position ORDER BY points_over_replacement) AS actual_percentile
    FROM por JOIN pr ON pr.entity_id = por.entity_id AND pr.season = por.season AND pr.position = por.position),
  un AS (
    SELECT por.*, NULL AS price, NULL AS price_rank, NULL AS preseason_percentile, NULL AS actual_percentile
    FROM por WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.entity_id = por.entity_id AND pr.season = por.season
      AND pr.position = por.position)),
  cb AS (SELECT * FROM tr UNION ALL SELECT * FROM un),
  ti AS (
    SELECT cb.*, started, CAST(ceil(position_rank * 1.0 / team_count) AS BIGINT) AS finish_tier,
           CAST(ceil(price_rank * 1.0 / team_count) AS BIGINT) AS expected_tier,
           position_rank <= team_count AS is_elite_finish,
           position_rank <= starters_at_position AS is_startable_finish
    FROM cb LEFT JOIN role ON role.entity_id = cb.entity_id AND role.season = cb.season),
  bb AS (
    SELECT *, expected_tier - finish_tier AS tier_delta, actual_percentile - preseason_percentile AS percentile_delta,
      CASE WHEN preseason_percentile IS NULL THEN 'No Preseason ADP'
           WHEN games_played < {MIN_GAMES} AND COALESCE(started, 0) >= 0.5 THEN 'Got Injured'
           WHEN games_played < {MIN_GAMES} THEN 'Never Had The Job'
           WHEN is_elite_finish AND expected_tier - finish_tier >= 1 THEN 'League Winner'
           WHEN is_elite_finish THEN 'Delivered'
           WHEN expected_tier - finish_tier >= 1 THEN 'Beat His Price'
           WHEN expected_tier - finish_tier <= -2 THEN 'Busted'
           WHEN expected_tier = finish_tier THEN 'Met His Price' ELSE 'Fine' END AS outcome_bucket
    FROM ti)"""


def buckets(t: Tables) -> DataFrame:
    orders = t.orders()
    starter = F.max(F.col("source").isin("1-URGENT", "2-HIGH"))
    chart = orders.groupBy("entity_id", "season", "week").agg(starter.alias("is_starter"))
    played = orders.where(F.col("status") != "P").select("entity_id", "season", "week").distinct()
    return outcome_buckets(
        t.gold("por", lambda: over_replacement(t, keep=["games_played", "team_count"])), price_ranks(asking_prices(t)),
        played_role(chart, played),
        min_games=MIN_GAMES,
    )


@query(
    "outcome_bucket",
    f"""WITH {_PRICED}, {ENT}, {POR}, {ASKING}, {CHART}, {BUCKETS}
    SELECT league_key, season, entity_id, position, games_played, price,
           round(preseason_percentile, 8) AS preseason_percentile, round(actual_percentile, 8) AS actual_percentile,
           round(percentile_delta, 8) AS percentile_delta, finish_tier, expected_tier, tier_delta,
           is_elite_finish, is_startable_finish, outcome_bucket FROM bb""",
)
def outcome_bucket(t: Tables) -> DataFrame:
    """Nine outcome buckets: finish against the price paid."""
    return buckets(t).select(
        "league_key", "season", "entity_id", "position", "games_played", "price",
        *[F.round(c, 8).alias(c) for c in ("preseason_percentile", "actual_percentile", "percentile_delta")],
        "finish_tier", "expected_tier", "tier_delta", "is_elite_finish", "is_startable_finish",
        "outcome_bucket",
    )
