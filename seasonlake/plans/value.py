"""Price curves, surplus boards, archetypes."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions.stats import floor_at
from seasonlake.functions.text import year_of
from seasonlake.operators.curve import curve_at, origin_scale, walk_forward_curve
from seasonlake.operators.history import prior_counters
from seasonlake.operators.outcomes import archetype, walk_forward_edge
from seasonlake.operators.ranking import with_rank
from seasonlake.operators.replacement import replacement_levels
from seasonlake.operators.settings import with_settings
from seasonlake.operators.value import surplus_ranks, surplus_rows
from seasonlake.plans.baselines import BASELINE, baseline
from seasonlake.plans.bindings import Tables
from seasonlake.plans.consensus import _PRICED
from seasonlake.plans.leagues import FIELDS, FLEX, POSITIONS, REFERENCE, SETTINGS, SLOTS
from seasonlake.plans.oracle_parts import ENT
from seasonlake.plans.outcomes import (
    _FLEX_IN, _IN, _SLOT_CASE, ASKING, BUCKETS, CHART, DEPTH, LEVELS, POR, asking_prices, buckets,
    league_pool,
)
from seasonlake.plans.registry import query
from seasonlake.session import pinned

CELL = ("league_key", "season", "position")


def slot_of(price):
    """Draft slot: a grid of a fixed number of steps over the price range."""
    return F.floor(price / 10).cast("long")


def priced_board(t: Tables) -> DataFrame:
    """Priced entities x leagues with realised points; absent is a real zero.

    An entity with no season at all is unresolved and dropped.
    """
    career = t.orders().select("entity_id").distinct()
    last = t.newest_season()
    asked = asking_prices(t).where(F.col("position").isin(*POSITIONS) & (F.col("season") <= last))
    asked = asked.join(career, "entity_id", "left_semi")
    board = with_settings(asked, SETTINGS, ["league_key"])
    points = league_pool(t).select("league_key", "season", "entity_id", "league_points")
    out = board.join(points, ["league_key", "season", "entity_id"], "left")
    return out.withColumn("never_played", F.col("league_points").isNull()).withColumn(
        "league_points", F.coalesce("league_points", F.lit(0.0))
    )


BOARD = f"""board AS (
    SELECT lg.league_key, ask.season, ask.entity_id, ask.position, ask.price,
           COALESCE(por.league_points, 0.0) AS league_points, por.entity_id IS NULL AS never_played
    FROM ask CROSS JOIN lg
    LEFT JOIN por ON por.entity_id = ask.entity_id AND por.season = ask.season AND por.league_key = lg.league_key
    WHERE ask.position IN {_IN} AND ask.season <= (SELECT max(season) FROM o)
      AND ask.entity_id IN (SELECT entity_id FROM o))"""


@query(
    "priced_board",
    f"""WITH {_PRICED}, {ENT}, {POR}, {ASKING}, {BOARD} SELECT * FROM board""",
)
def priced_board_query(t: Tables) -> DataFrame:
    return priced_board(t).select(
        "league_key", "season", "entity_id", "position", "price", "league_points", "never_played"
    )


BOARD_COLUMNS = ["league_key", "season", "entity_id", "position", "price", "slot",
                 "actual_por", "actual_value", "never_played"]


def valued_board(t: Tables) -> DataFrame:
    """Board with points over replacement and the value floored at zero."""
    levels = replacement_levels(league_pool(t), ("league_key", "season"), SLOTS, FLEX, DEPTH)
    df = priced_board(t).join(levels, list(CELL), "left")
    por = F.col("league_points") - F.col("replacement_level_points")
    valued = df.withColumn("actual_por", por).withColumn(
        "actual_value", floor_at(por, 0.0)
    ).withColumn("slot", slot_of(F.col("price")))
    return pinned(valued.select(*BOARD_COLUMNS))


def price_curves(t: Tables, valued: DataFrame) -> DataFrame:
    """Curve per (league, position, season), the live season included."""
    last = t.newest_season() + 1
    return walk_forward_curve(valued, ("league_key", "position"), "slot", "actual_value", last)


VALUED = """val AS (
    SELECT board.*, starters_at_position, replacement_level_points,
           league_points - replacement_level_points AS actual_por,
           greatest(league_points - replacement_level_points, 0.0) AS actual_value,
           CAST(floor(price / 10) AS BIGINT) AS slot
    FROM board LEFT JOIN lev USING (league_key, season, position))"""
CURVE = """grid AS (
    SELECT v.league_key, v.position, ts.season, slot, sum(actual_value) AS s, count(*) AS n
    FROM val v JOIN (SELECT DISTINCT season FROM ask) ts ON v.season < ts.season GROUP BY ALL),
  gate AS (
    SELECT v.league_key, v.position, ts.season, count(DISTINCT v.season) AS curve_train_seasons
    FROM val v JOIN (SELECT DISTINCT season FROM ask) ts ON v.season < ts.season
    GROUP BY ALL HAVING count(DISTINCT v.season) >= 3 AND count(*) >= 60),
  gi AS (
    SELECT grid.*, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn
    FROM grid JOIN gate USING (league_key, position, season)
    WINDOW w AS (PARTITION BY league_key, position, season ORDER BY slot)),
  means AS (
    SELECT a.league_key, a.position, a.season, a.i, b.i AS j,
           (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m
    FROM gi a JOIN gi b USING (league_key, position, season) WHERE a.i <= b.i),
  best AS (SELECT league_key, position, season, i, j,
             max(m) OVER (PARTITION BY league_key, position, season, i ORDER BY j DESC) AS top FROM means),
  fit AS (
    SELECT b.league_key, b.position, b.season, g.slot, min(top) AS y
    FROM best b JOIN gi g ON g.league_key = b.league_key AND g.position = b.position AND g.season = b.season AND g.i = b.j
    GROUP BY ALL),
  want AS (
    SELECT DISTINCT gate.league_key, gate.position, gate.season, CAST(floor(price / 10) AS BIGINT) AS slot, curve_train_seasons
    FROM ask JOIN gate ON gate.position = ask.position AND gate.season = ask.season),
  near AS (
    SELECT w.*, (SELECT max(f.slot) FROM fit f WHERE f.league_key = w.league_key AND f.position = w.position AND f.season = w.season AND f.slot <= w.slot) AS lo,
           (SELECT min(f.slot) FROM fit f WHERE f.league_key = w.league_key AND f.position = w.position AND f.season = w.season AND f.slot >= w.slot) AS hi
    FROM want w),
  curve AS (
    SELECT n.league_key, n.position, n.season, n.slot, n.curve_train_seasons,
      round(CASE WHEN lo IS NULL THEN b.y WHEN hi IS NULL OR lo = hi THEN a.y
           ELSE a.y + (b.y - a.y) / (hi - lo) * (n.slot - lo) END, 2) AS expected_value
    FROM near n
    LEFT JOIN fit a ON a.league_key = n.league_key AND a.position = n.position AND a.season = n.season AND a.slot = n.lo
    LEFT JOIN fit b ON b.league_key = n.league_key AND b.position = n.position AND b.season = n.season AND b.slot = n.hi)"""


@query(
    "isotonic_curve",
    f"""WITH {_PRICED}, {ENT}, {POR}, {ASKING}, {BOARD}, {VALUED}, {CURVE}
    SELECT league_key, position, season, slot, curve_train_seasons, expected_value FROM curve""",
)
def isotonic_curve(t: Tables) -> DataFrame:
    """Non-increasing value on price per league and position, earlier seasons only."""
    valued = valued_board(t)
    curves = pinned(price_curves(t, valued))
    cell = ["league_key", "position", "season"]
    trained = curves.select(*cell, "curve_train_seasons").distinct()
    want = asking_prices(t).select("position", "season", slot_of(F.col("price")).alias("slot")).distinct()
    want = want.join(trained, ["position", "season"])
    return want.join(curve_at(curves, want, cell, "slot"), [*cell, "slot"]).select(
        *cell, "slot", "curve_train_seasons", F.round("expected_value", 2).alias("expected_value")
    )


def projected_values(t: Tables) -> DataFrame:
    """Baseline rate x games, moved to league points and measured over replacement."""
    base = baseline(t).select(
        "entity_id", F.col("target_season").alias("season"),
        F.round(F.col("weighted_ppg") * F.col("weighted_games_per_season"), 0).alias("projected_points"),
    )
    people = t.entities().where(F.col("position").isin(*POSITIONS)).select("entity_id", "position")
    pool = with_settings(base.join(people, "entity_id"), SETTINGS, FIELDS)
    scale = origin_scale(league_pool(t), ("league_key", "position"), "points_c", "league_points")
    scale = scale.withColumn("scale", F.round("scale", 8))
    pool = pool.join(scale, ["league_key", "position"]).withColumn(
        "league_points", F.round(F.col("projected_points") * F.col("scale"), 2)
    )
    pool = pinned(pool)
    levels = replacement_levels(pool, ("league_key", "season"), SLOTS, FLEX, DEPTH)
    por = F.round(F.col("league_points") - F.col("replacement_level_points"), 2)
    return pool.join(levels, list(CELL)).select(
        "league_key", "season", "entity_id", por.alias("projected_por"),
        floor_at(por, 0.0).alias("projected_value"),
    )


PROJECTED = f"""sc AS (
    SELECT league_key, position, round(sum(CAST(points_c AS DOUBLE) * league_points) / sum(CAST(points_c AS DOUBLE) * points_c), 8) AS scale
    FROM por WHERE points_c > 0 GROUP BY ALL),
  ppool AS (
    SELECT bl.entity_id, target_season AS season, ent.position, lg.*, team_count * {_SLOT_CASE.replace('CASE position', 'CASE ent.position')} AS dedicated,
           round(round(weighted_ppg * weighted_games_per_season, 0) * scale, 2) AS league_points
    FROM bl JOIN ent USING (entity_id) CROSS JOIN lg
    JOIN sc ON sc.league_key = lg.league_key AND sc.position = ent.position),
  {LEVELS.format(p='p', pool='ppool', flex=_FLEX_IN)},
  proj AS (SELECT prk.league_key, prk.season, entity_id, round(league_points - replacement_level_points, 2) AS projected_por,
                  greatest(round(league_points - replacement_level_points, 2), 0.0) AS projected_value
           FROM prk JOIN plev USING (league_key, season, position))"""
SURPLUS = """allb AS (
    SELECT league_key, season, entity_id, position, price, actual_por, actual_value, never_played, slot FROM val
    UNION ALL
    SELECT lg.league_key, season, entity_id, position, price, NULL, NULL, false, CAST(floor(price / 10) AS BIGINT)
    FROM ask CROSS JOIN lg WHERE season = (SELECT max(season) FROM ask) AND position IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
      AND season > (SELECT max(season) FROM o)),
  su AS (
    SELECT a.*, expected_value, curve_train_seasons, projected_por, projected_value,
           actual_value - expected_value AS surplus_value, projected_value - expected_value AS projected_surplus
    FROM allb a LEFT JOIN curve USING (league_key, position, season, slot)
    LEFT JOIN proj USING (league_key, season, entity_id)),
  dv AS (
    SELECT league_key, season, entity_id, position, price, never_played, curve_train_seasons,
      expected_value, actual_value, round(surplus_value, 2) AS surplus_value, projected_value,
      round(projected_surplus, 2) AS projected_surplus, actual_por, projected_por,
      CASE WHEN surplus_value IS NOT NULL THEN rank() OVER (PARTITION BY league_key, season ORDER BY round(surplus_value, 2) DESC NULLS LAST) END AS surplus_rank,
      CASE WHEN projected_surplus IS NOT NULL THEN rank() OVER (PARTITION BY league_key, season ORDER BY round(projected_surplus, 2) DESC NULLS LAST) END AS projected_surplus_rank,
      round(surplus_value - avg(surplus_value) OVER (PARTITION BY league_key, season), 1) AS surplus_centered
    FROM su)"""


def unranked_surplus(t: Tables) -> DataFrame:
    """The stored rows of ``surplus_board`` without its ranks, each of which moves all rows again."""
    return t.gold("unranked_surplus", lambda: build_unranked_surplus(t))


def build_unranked_surplus(t: Tables) -> DataFrame:
    valued = valued_board(t)
    curves = price_curves(t, valued)
    asked = asking_prices(t).where(F.col("position").isin(*POSITIONS))
    last = t.newest_season()
    live = with_settings(asked.where(F.col("season") > last), SETTINGS, ["league_key"])
    live = live.select(
        "league_key", "season", "entity_id", "position", "price", slot_of(F.col("price")).alias("slot"),
        F.lit(None).cast("double").alias("actual_por"),
        F.lit(None).cast("double").alias("actual_value"), F.lit(False).alias("never_played"),
    )
    board = valued.unionByName(live)
    df = surplus_rows(board, curves, projected_values(t), "slot", digits=2)
    return df.withColumn("surplus_centered", F.round("surplus_centered", 1))


def surplus_board(t: Tables) -> DataFrame:
    """Realised and projected surplus over what the price has returned before."""
    return surplus_ranks(unranked_surplus(t)).select(
        "league_key", "season", "entity_id", "position", "price", "never_played",
        "curve_train_seasons", "expected_value", "actual_value", "surplus_value", "projected_value",
        "projected_surplus", "actual_por", "projected_por", "surplus_rank", "projected_surplus_rank",
        "surplus_centered",
    )


FULL_VALUE = f"""{_PRICED}, {ENT}, {POR}, {ASKING}, {BOARD}, {VALUED}, {CURVE}, {BASELINE}, {PROJECTED}, {SURPLUS}"""


@query("surplus_board", f"WITH {FULL_VALUE} SELECT * FROM dv")
def surplus_board_query(t: Tables) -> DataFrame:
    return surplus_board(t)


@query(
    "percentile_gap",
    f"""WITH {_PRICED}, {ENT}, {ASKING}, {BASELINE},
    pre AS (SELECT *, percent_rank() OVER (PARTITION BY season, position ORDER BY price DESC) AS preseason_percentile FROM ask),
    pd AS (SELECT bl.entity_id, target_season, position, round(weighted_ppg * weighted_games_per_season, 0) AS projected_points,
             percent_rank() OVER (PARTITION BY target_season, position ORDER BY round(weighted_ppg * weighted_games_per_season, 0)) AS predicted_percentile
           FROM bl JOIN ent USING (entity_id))
    SELECT pd.target_season, pd.entity_id, pd.position, projected_points, round(predicted_percentile, 8) AS predicted_percentile,
           price, round(preseason_percentile, 8) AS preseason_percentile,
           round(predicted_percentile - preseason_percentile, 8) AS predicted_delta
    FROM pd LEFT JOIN pre ON pre.entity_id = pd.entity_id AND pre.season = pd.target_season AND pre.position = pd.position""",
)
def percentile_gap(t: Tables) -> DataFrame:
    """Where a prediction and the market disagree; NULL when unpriced."""
    market = with_rank(
        asking_prices(t), ("season", "position"), "price", percent_rank_desc="preseason_percentile"
    ).select("entity_id", F.col("season").alias("target_season"), "position", "price", "preseason_percentile")
    said = baseline(t).select(
        "entity_id", "target_season",
        F.round(F.col("weighted_ppg") * F.col("weighted_games_per_season"), 0).alias("projected_points"),
    ).join(t.entities().select("entity_id", "position"), "entity_id")
    said = with_rank(
        said, ("target_season", "position"), "projected_points", percent_rank="predicted_percentile"
    )
    out = said.join(market, ["entity_id", "target_season", "position"], "left")
    gap = F.col("predicted_percentile") - F.col("preseason_percentile")
    return out.select(
        "target_season", "entity_id", "position", "projected_points",
        F.round("predicted_percentile", 8).alias("predicted_percentile"), "price",
        F.round("preseason_percentile", 8).alias("preseason_percentile"),
        F.round(gap, 8).alias("predicted_delta"),
    )


def people_facts(t: Tables) -> DataFrame:
    """First season and a birth date text, unreadable for some."""
    first = t.orders().groupBy("entity_id").agg(F.min("season").alias("first_season"))
    born = F.when(F.col("entity_id") % 37 == 0, F.lit("n/a")).otherwise(
        F.concat((1965 + F.col("entity_id") % 13).cast("string"), F.lit("-06-01"))
    )
    return first.withColumn("birth_date", born)


def archetype_frame(t: Tables) -> DataFrame:
    """Priced rows with prior counters, class and walk-forward edge."""
    results = t.gold("buckets", lambda: buckets(t)).select(
        "league_key", "season", "entity_id", "position", "price", "outcome_bucket", "is_elite_finish"
    )
    last = t.newest_season()
    live = with_settings(
        asking_prices(t).where(F.col("position").isin(*POSITIONS) & (F.col("season") > last)),
        SETTINGS, ["league_key"],
    ).select("league_key", "season", "entity_id", "position", "price")
    rows = results.unionByName(live, allowMissingColumns=True)
    rows = prior_counters(rows, ["league_key", "entity_id"], F.col("is_elite_finish"))
    rows = rows.where(F.col("price").isNotNull())
    rows = rows.join(people_facts(t), "entity_id", "left")
    surplus = unranked_surplus(t).select("league_key", "season", "entity_id", "surplus_centered", "projected_surplus")
    rows = rows.join(surplus, ["league_key", "season", "entity_id"], "left")
    rows = rows.withColumn("seasons_of_experience", F.col("season") - F.col("first_season"))
    rows = rows.withColumn("age_at_season", F.col("season") - year_of(F.col("birth_date")))
    rows = rows.withColumn(
        "archetype",
        archetype(F.col("prior_elite"), F.col("age_at_season"), F.col("seasons_of_experience"),
                  youth=2, veteran_experience=6, veteran_age=30),
    ).where(F.col("archetype").isNotNull())
    rows = pinned(rows)
    return walk_forward_edge(rows, REFERENCE, min_rows=20, min_t=1.0, min_seasons=2)


ARCHETYPE = f"""{FULL_VALUE}, {CHART}, {BUCKETS},
  pop AS (
    SELECT league_key, season, entity_id, position, price, outcome_bucket, is_elite_finish FROM bb WHERE price IS NOT NULL
    UNION ALL
    SELECT lg.league_key, season, entity_id, position, price, NULL, NULL FROM ask CROSS JOIN lg
    WHERE season > (SELECT max(season) FROM o) AND position IN {_IN}),
  career AS (
    SELECT p.league_key, p.season, p.entity_id, count(b.season) AS prior_seasons,
      CAST(COALESCE(sum(CASE WHEN b.is_elite_finish THEN 1 ELSE 0 END), 0) AS BIGINT) AS prior_elite,
      max(CASE WHEN b.season = p.season - 1 AND b.is_elite_finish THEN 1 ELSE 0 END) AS elite_last_season
    FROM pop p LEFT JOIN bb b ON b.entity_id = p.entity_id AND b.league_key = p.league_key AND b.season < p.season
    GROUP BY 1, 2, 3),
  facts AS (SELECT entity_id, min(season) AS first_season,
      CASE WHEN entity_id % 37 = 0 THEN 'n/a' ELSE CAST(1965 + entity_id % 13 AS VARCHAR) || '-06-01' END AS birth_date
    FROM o GROUP BY entity_id),
  ar0 AS (
    SELECT p.*, prior_seasons, prior_elite, elite_last_season, p.season - first_season AS experience,
           p.season - year(TRY_CAST(birth_date AS DATE)) AS age, dv.surplus_centered, dv.projected_surplus
    FROM pop p JOIN career c USING (league_key, season, entity_id) LEFT JOIN facts USING (entity_id)
    LEFT JOIN dv USING (league_key, season, entity_id)),
  ar AS (
    SELECT *, CASE WHEN prior_elite = 0 AND experience <= 2 THEN 'Unproven Youth'
      WHEN prior_elite > 0 AND (age >= 30 OR experience >= 6) THEN 'Proven Veteran'
      WHEN prior_elite > 0 THEN 'Proven Prime'
      WHEN age >= 30 OR experience >= 6 THEN 'Unproven Veteran' ELSE 'Unproven Prime' END AS archetype
    FROM ar0 WHERE age IS NOT NULL AND experience IS NOT NULL),
  tgt AS (SELECT t.season, count(DISTINCT a.season) AS k FROM (SELECT DISTINCT season FROM ar) t
          LEFT JOIN ar a ON a.season < t.season AND a.surplus_centered IS NOT NULL GROUP BY 1),
  ed AS (
    SELECT t.season, position, archetype,
      CASE WHEN count(*) >= 20 AND abs(avg(surplus_centered) / nullif(stddev_samp(surplus_centered) / sqrt(count(*)), 0)) >= 1.0
           THEN avg(surplus_centered) ELSE 0.0 END AS edge
    FROM tgt t JOIN ar a ON a.season < t.season AND a.surplus_centered IS NOT NULL AND a.league_key = '{REFERENCE}'
    GROUP BY 1, 2, 3),
  af AS (
    SELECT ar.*, CASE WHEN k >= 2 THEN COALESCE(edge, 0.0) END AS archetype_edge
    FROM ar JOIN tgt ON tgt.season = ar.season LEFT JOIN ed ON ed.season = ar.season AND ed.position = ar.position AND ed.archetype = ar.archetype)"""


@query(
    "archetype_class",
    f"""WITH {ARCHETYPE}
    SELECT league_key, season, entity_id, position, prior_seasons, prior_elite, elite_last_season, archetype,
           surplus_centered, round(archetype_edge, 2) AS archetype_edge FROM af""",
)
def archetype_class(t: Tables) -> DataFrame:
    """Five-cell class per priced row and the edge earlier seasons support."""
    return archetype_frame(t).select(
        "league_key", "season", "entity_id", "position", "prior_seasons", "prior_elite",
        "elite_last_season", "archetype", "surplus_centered",
        F.round("archetype_edge", 2).alias("archetype_edge"),
    )
