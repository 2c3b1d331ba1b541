"""Drafted rosters: a board dealt to teams, scored, summarised and tested.

One board per (season, region): its entities in price order, dealt by the snake
rule to each league's teams. A team's strategy is what its first five picks are.
"""

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions.text import composition_label, label_count
from seasonlake.operators import lineup
from seasonlake.operators.folds import clustered_test
from seasonlake.operators.ranking import spearman, top_k, with_position
from seasonlake.operators.settings import with_settings
from seasonlake.operators.strategy import against_field, in_every_group, strategy_summary
from seasonlake.plans.bindings import Tables
from seasonlake.plans.consensus import _PRICED
from seasonlake.plans.leagues import FIELDS, FLEX_POSITIONS, LG, POSITIONS, SETTINGS, SLOTS
from seasonlake.plans.oracle_parts import ENT, O
from seasonlake.plans.outcomes import _IN, ASKING, POOL, asking_prices, league_pool
from seasonlake.plans.registry import query
from seasonlake.session import pinned

OPENING = 5
SHORT = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "F", "HOUSEHOLD": "H"}
POOLS = [("flex_slots", FLEX_POSITIONS), ("superflex_slots", POSITIONS)]


def boards(t: Tables) -> DataFrame:
    """Board place of every priced entity that has a played season, per (season, region)."""
    region = t.raw("customer").select(F.col("c_custkey").alias("entity_id"), "c_nationkey").join(
        t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region")),
        "c_nationkey",
    ).select("entity_id", "region")
    last = t.newest_season()
    asked = asking_prices(t).where(F.col("position").isin(*POSITIONS) & (F.col("season") <= last))
    asked = asked.join(region, "entity_id").select("season", "region", "entity_id", "position", "price")
    return with_position(asked, ("season", "region"), "price", "entity_id", descending=False, name="pick")


BOARDS = f"""bo AS (
    SELECT ask.season, n_regionkey AS region, ask.entity_id, ask.position, ask.price,
           row_number() OVER (PARTITION BY ask.season, n_regionkey ORDER BY ask.price, ask.entity_id) AS pick
    FROM ask JOIN customer ON c_custkey = ask.entity_id JOIN nation ON n_nationkey = c_nationkey
    WHERE ask.position IN {_IN} AND ask.season <= (SELECT max(season) FROM o))"""


@query(
    "snake_allocation",
    f"""WITH {_PRICED}, {ENT}, {ASKING}, {LG}, {BOARDS},
    d AS (SELECT league_key, season, region, entity_id, pick, CAST((pick - 1) // team_count AS BIGINT) AS turn, (pick - 1) % team_count AS seat, team_count
          FROM bo CROSS JOIN lg)
    SELECT league_key, season, CAST(region AS INT) AS region, entity_id, pick, turn + 1 AS round,
           CAST(CASE WHEN turn % 2 = 0 THEN seat ELSE team_count - 1 - seat END + 1 AS BIGINT) AS draft_slot FROM d""",
)
def snake_allocation(t: Tables) -> DataFrame:
    """The whole board dealt to each league's teams."""
    df = with_settings(boards(t), SETTINGS, ["league_key", "team_count"])
    turn, team = lineup.snake(F.col("pick"), F.col("team_count"))
    return df.select(
        "league_key", "season", "region", "entity_id", "pick", turn.alias("round"), team.alias("draft_slot")
    )


def rosters(t: Tables) -> DataFrame:
    """Drafted rows per (league, variant, season, region, draft_slot) with realised points."""
    df = with_settings(boards(t), SETTINGS, FIELDS)
    df = lineup.format_variants(df, list(SLOTS.values()))
    turn, team = lineup.snake(F.col("pick"), F.col("team_count"))
    df = df.withColumn("round", turn).withColumn("draft_slot", team).where(F.col("round") <= F.col("rounds"))
    points = league_pool(t).select("league_key", "season", "entity_id", "league_points")
    return df.join(points, ["league_key", "season", "entity_id"], "left").withColumn(
        "league_points", F.coalesce("league_points", F.lit(0.0))
    )


TRIAL = ["league_key", "variant", "season", "region"]
_OPEN = " || ".join(
    f"CASE WHEN n_{p} > 0 THEN CAST(n_{p} AS VARCHAR) || '{s}' ELSE '' END" for p, s in SHORT.items()
)
_OPEN_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE round <= {OPENING} AND position = '{p}') AS n_{p}" for p in SHORT
)
_D_SLOTS = "CASE d.position " + " ".join(f"WHEN '{p}' THEN d.{c}" for p, c in SLOTS.items()) + " END"
ROSTERS = f"""{POOL}, {ASKING}, {BOARDS},
  va AS (
    SELECT lg.* EXCLUDE (flex_slots, superflex_slots, bench_slots), variant,
      (variant = 'superflex') = (superflex_slots > 0) AS is_actual,
      superflex_slots + d AS superflex_slots,
      flex_slots - CASE WHEN d > 0 THEN least(d, flex_slots) ELSE d END AS flex_slots,
      bench_slots - CASE WHEN d > 0 THEN d - least(d, flex_slots) ELSE 0 END AS bench_slots
    FROM (SELECT lg.*, v.variant, CASE WHEN v.variant = 'superflex' THEN 1 ELSE 0 END - superflex_slots AS d
          FROM lg CROSS JOIN (VALUES ('1qb'), ('superflex')) v(variant)) lg),
  dealt AS (
    SELECT va.*, bo.*, (pick - 1) // team_count + 1 AS round,
      CASE WHEN ((pick - 1) // team_count) % 2 = 0 THEN (pick - 1) % team_count ELSE team_count - 1 - (pick - 1) % team_count END + 1 AS draft_slot,
      automobile_slots + building_slots + furniture_slots + household_slots + flex_slots + superflex_slots + bench_slots AS rounds
    FROM bo CROSS JOIN va),
  ro AS (
    SELECT d.*, COALESCE(p.league_points, 0.0) AS pts, {_D_SLOTS} AS own
    FROM dealt d LEFT JOIN pool p ON p.league_key = d.league_key AND p.season = d.season AND p.entity_id = d.entity_id
    WHERE d.round <= d.rounds),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY league_key, variant, season, region, draft_slot, position ORDER BY pts DESC, entity_id) <= own AS in1 FROM ro),
  r2 AS (SELECT *, NOT in1 AND position IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') AND
           row_number() OVER (PARTITION BY league_key, variant, season, region, draft_slot, (NOT in1 AND position IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD'))
             ORDER BY pts DESC, entity_id) <= flex_slots AS in2 FROM r1),
  r3 AS (SELECT *, NOT in1 AND NOT in2 AND
           row_number() OVER (PARTITION BY league_key, variant, season, region, draft_slot, (NOT in1 AND NOT in2) ORDER BY pts DESC, entity_id) <= superflex_slots AS in3 FROM r2),
  tt0 AS (
    SELECT league_key, variant, season, region, draft_slot, any_value(team_count) AS team_count, any_value(is_actual) AS is_actual,
      COALESCE(sum(pts) FILTER (WHERE in1 OR in2 OR in3), 0.0) AS starter_points, {_OPEN_COUNTS}
    FROM r3 GROUP BY ALL),
  tt AS (SELECT * EXCLUDE ({", ".join("n_" + p for p in SHORT)}), {_OPEN} AS strategy FROM tt0),
  res AS (
    SELECT *, (sum(starter_points) OVER w - starter_points) / (count(*) OVER w - 1) AS field_points,
      starter_points - (sum(starter_points) OVER w - starter_points) / (count(*) OVER w - 1) AS points_vs_field,
      rank() OVER (PARTITION BY league_key, variant, season, region ORDER BY starter_points DESC) AS finish_rank
    FROM tt WINDOW w AS (PARTITION BY league_key, variant, season, region))"""


def trial_results(t: Tables) -> DataFrame:
    """One row per drafted team: strategy label, lineup total, edge over the field, finish."""
    drafted = pinned(rosters(t))
    seat = [*TRIAL, "draft_slot"]
    totals = lineup.lineup_value(drafted, seat, SLOTS, POOLS)
    opening = F.col("round") <= OPENING
    counts = drafted.groupBy(*seat).agg(
        F.max("team_count").alias("team_count"), F.max("is_actual").alias("is_actual"),
        *[F.count_if(opening & (F.col("position") == p)).alias(f"n_{p}") for p in SHORT],
    )
    label = composition_label([(s, F.col(f"n_{p}")) for p, s in SHORT.items()])
    rows = totals.join(counts, seat).withColumn("strategy", label)
    rows = against_field(rows, TRIAL)
    return rows.drop(*[f"n_{p}" for p in SHORT])


def results(t: Tables) -> DataFrame:
    return t.gold("trials", lambda: trial_results(t))


@query(
    "best_lineup",
    f"""WITH {_PRICED}, {ENT}, {ROSTERS}
    SELECT league_key, variant, season, CAST(region AS INT) AS region, CAST(draft_slot AS BIGINT) AS draft_slot, strategy, is_actual, round(starter_points, 2) AS starter_points,
           round(points_vs_field, 2) AS points_vs_field, finish_rank FROM res""",
)
def best_lineup(t: Tables) -> DataFrame:
    """Best starting total of every dealt roster, in both lineup formats."""
    return trial_results(t).select(
        *TRIAL, "draft_slot", "strategy", "is_actual",
        F.round("starter_points", 2).alias("starter_points"),
        F.round("points_vs_field", 2).alias("points_vs_field"), "finish_rank",
    )


_P_VALUE = """CASE n_seasons - 1
    WHEN 1 THEN 1 - 2 / pi() * th
    WHEN 2 THEN 1 - sin(th)
    WHEN 3 THEN 1 - 2 / pi() * (th + sin(th) * cos(th))
    WHEN 4 THEN 1 - sin(th) * (1 + pow(cos(th), 2) / 2)
    WHEN 5 THEN 1 - 2 / pi() * (th + sin(th) * cos(th) * (1 + pow(cos(th), 2) * 2 / 3))
    WHEN 6 THEN 1 - sin(th) * (1 + pow(cos(th), 2) / 2 + pow(cos(th), 4) * 3 / 8) END"""
SUMMARY = f"""sm0 AS (
    SELECT league_key, variant, strategy, season, avg(points_vs_field) AS m FROM res GROUP BY ALL),
  sm1 AS (
    SELECT league_key, variant, strategy, count(*) AS n_seasons,
      CASE WHEN max(m) - min(m) >= 1e-6 THEN count(*) FILTER (WHERE m > 0) ELSE 0 END AS seasons_positive,
      CASE WHEN count(*) > 1 AND max(m) - min(m) > 1e-6 THEN avg(m) / (stddev_samp(m) / sqrt(count(*))) END AS t_stat
    FROM sm0 GROUP BY ALL),
  sm2 AS (SELECT *, atan(abs(t_stat) / sqrt(n_seasons - 1)) AS th FROM sm1 WHERE n_seasons > 1
          UNION ALL SELECT *, NULL FROM sm1 WHERE n_seasons <= 1),
  fl AS (
    SELECT league_key, variant, strategy, any_value(is_actual) AS is_actual, count(*) AS n_drafts, avg(starter_points) AS starter_points,
      avg(points_vs_field) AS points_vs_field, avg(finish_rank) AS finish_rank,
      avg(CASE WHEN finish_rank = 1 THEN 1.0 ELSE 0.0 END) AS win_rate,
      avg(CASE WHEN finish_rank <= ceil(team_count / 3.0) THEN 1.0 ELSE 0.0 END) AS top_third_rate
    FROM res GROUP BY ALL),
  ds AS (SELECT fl.*, n_seasons, seasons_positive, t_stat, {_P_VALUE} AS p_value
         FROM fl JOIN sm2 USING (league_key, variant, strategy))"""
STRATEGY = f"{_PRICED}, {ENT}, {ROSTERS}, {SUMMARY}"
_ROUNDED = {"starter_points": 3, "points_vs_field": 3, "finish_rank": 6, "win_rate": 6,
            "top_third_rate": 6, "t_stat": 6, "p_value": 6}


def summary(t: Tables) -> DataFrame:
    return strategy_summary(results(t), ["league_key", "variant", "strategy", "is_actual"])


@query(
    "strategy_summary",
    f"""WITH {STRATEGY} SELECT league_key, variant, strategy, is_actual, n_drafts, n_seasons, seasons_positive, """
    + ", ".join(f"round({c}, {d}) AS {c}" for c, d in _ROUNDED.items()) + " FROM ds",
)
def strategy_summary_query(t: Tables) -> DataFrame:
    """One row per opening: means, win and top-third rates, season-clustered t-test."""
    return summary(t).select(
        "league_key", "variant", "strategy", "is_actual", "n_drafts", "n_seasons", "seasons_positive",
        *[F.round(c, d).alias(c) for c, d in _ROUNDED.items()],
    )


@query(
    "ranking_agreement",
    f"""WITH {STRATEGY},
    j AS (SELECT a.league_key, a.strategy, round(a.points_vs_field, 2) AS x, round(b.points_vs_field, 2) AS y FROM ds a JOIN ds b
          ON a.league_key = b.league_key AND a.strategy = b.strategy AND a.variant = '1qb' AND b.variant = 'superflex'),
    r AS (SELECT *, rank() OVER (PARTITION BY league_key ORDER BY x) + (count(*) OVER (PARTITION BY league_key, x) - 1) / 2.0 AS rx,
                 rank() OVER (PARTITION BY league_key ORDER BY y) + (count(*) OVER (PARTITION BY league_key, y) - 1) / 2.0 AS ry FROM j)
    SELECT league_key, count(*) AS strategies, round(corr(rx, ry), 6) AS rank_correlation FROM r GROUP BY league_key""",
)
def ranking_agreement(t: Tables) -> DataFrame:
    """How far the two formats agree about the order of openings."""
    ranked = summary(t).withColumn("points_vs_field", F.round("points_vs_field", 2))
    one = ranked.where(F.col("variant") == "1qb").select("league_key", "strategy", F.col("points_vs_field").alias("x"))
    two = ranked.where(F.col("variant") == "superflex").select("league_key", "strategy", F.col("points_vs_field").alias("y"))
    both = pinned(one.join(two, ["league_key", "strategy"]))
    # at most as many openings as there are compositions
    agreed = spearman(both, ["league_key"], "x", "y", "rank_correlation", bounded=True)
    counts = both.groupBy("league_key").agg(F.count(F.lit(1)).alias("strategies"))
    return counts.join(agreed, "league_key").withColumn("rank_correlation", F.round("rank_correlation", 6))


@query(
    "in_all_groups",
    f"""WITH {STRATEGY}, good AS (SELECT * FROM ds WHERE is_actual AND t_stat > 2)
    SELECT strategy FROM good GROUP BY strategy
    HAVING count(DISTINCT league_key) = (SELECT count(DISTINCT league_key) FROM ds)""",
)
def in_all_groups(t: Tables) -> DataFrame:
    """Openings significantly better than the field in every league's real format."""
    every = pinned(summary(t).select("strategy", "league_key", "is_actual", "t_stat"))
    good = every.where(F.col("is_actual") & (F.col("t_stat") > 2))
    return in_every_group(good, "strategy", "league_key", every)


@query(
    "slope_test",
    f"""WITH {_PRICED}, {ENT}, {ROSTERS},
    po AS (SELECT unnest(['A', 'B', 'F', 'H']) AS position),
    c AS (SELECT league_key, season, po.position, points_vs_field,
             COALESCE(TRY_CAST(regexp_extract(strategy, '(\\d)' || po.position, 1) AS BIGINT), 0) AS n FROM res CROSS JOIN po WHERE is_actual),
    cell AS (SELECT league_key, position, season, n, avg(points_vs_field) AS m FROM c GROUP BY ALL),
    slp AS (SELECT league_key, position, season, regr_slope(m, n) AS slope FROM cell GROUP BY ALL HAVING count(DISTINCT n) > 1),
    ts AS (SELECT league_key, position, count(*) AS n_seasons, avg(slope) AS mean_slope,
             CASE WHEN count(*) > 1 AND max(slope) - min(slope) > 1e-6 THEN avg(slope) / (stddev_samp(slope) / sqrt(count(*))) END AS t_stat
           FROM slp GROUP BY ALL),
    th AS (SELECT *, atan(abs(t_stat) / sqrt(n_seasons - 1)) AS th FROM ts)
    SELECT league_key, position, n_seasons, round(mean_slope, 2) AS mean_slope, round(t_stat, 6) AS t_stat, round({_P_VALUE}, 6) AS p_value FROM th""",
)
def slope_test(t: Tables) -> DataFrame:
    """Value of one more opening pick at a position, tested over seasons."""
    actual = results(t).where("is_actual")
    arms = [
        actual.select("league_key", "season", F.lit(p).alias("position"), "points_vs_field",
                       label_count(F.col("strategy"), p).alias("n"))
        for p in SHORT.values()
    ]
    long = arms[0]
    for arm in arms[1:]:
        long = long.unionByName(arm)
    cells = long.groupBy("league_key", "position", "season", "n").agg(F.avg("points_vs_field").alias("m"))
    slopes = cells.groupBy("league_key", "position", "season").agg(
        F.regr_slope("m", "n").alias("slope"), F.countDistinct("n").alias("_k")
    ).where(F.col("_k") > 1)
    tests = clustered_test(slopes, ["league_key", "position"], "season", "slope")
    means = slopes.groupBy("league_key", "position").agg(F.round(F.avg("slope"), 2).alias("mean_slope"))
    return means.join(tests, ["league_key", "position"]).select(
        "league_key", "position", F.col("n_clusters").alias("n_seasons"), "mean_slope",
        F.round("t_stat", 6).alias("t_stat"), F.round("p_value", 6).alias("p_value"),
    )


OPENING_CAPS = {"A": 2, "B": 5, "F": 5, "H": 2}
HEADLINES = ({"B": 3, "F": 2}, {"B": 2, "F": 3})


@query(
    "composition_value",
    f"""WITH {O}, {ENT}, {POOL},
    rk AS (SELECT league_key, season, position, league_points,
             row_number() OVER (PARTITION BY league_key, season, position ORDER BY league_points DESC, entity_id) AS rn FROM pool),
    cum AS (SELECT league_key, season, position, rn, sum(league_points) OVER (PARTITION BY league_key, season, position ORDER BY rn) AS total FROM rk WHERE rn <= 5),
    comp AS (SELECT a.n AS a, b.n AS b, f.n AS f, h.n AS h FROM range(0, 3) a(n), range(0, 6) b(n), range(0, 6) f(n), range(0, 3) h(n)
             WHERE a.n + b.n + f.n + h.n = 5),
    lab AS (SELECT *, {" || ".join(f"CASE WHEN {x} > 0 THEN CAST({x} AS VARCHAR) || '{x.upper()}' ELSE '' END" for x in "abfh")} AS strategy FROM comp)
    SELECT league_key, season, strategy, round(sum(total), 2) AS opening_points
    FROM lab JOIN cum ON (position = 'AUTOMOBILE' AND rn = a) OR (position = 'BUILDING' AND rn = b)
      OR (position = 'FURNITURE' AND rn = f) OR (position = 'HOUSEHOLD' AND rn = h)
    GROUP BY ALL""",
)
def composition_value(t: Tables) -> DataFrame:
    """What each of the 36 openings would hold with hindsight: sums of the best per position."""
    from pyspark.sql.window import Window as W

    order = [F.col("league_points").desc(), F.col("entity_id")]
    cell = ["league_key", "season", "position"]
    best = top_k(league_pool(t), cell, order, OPENING, "n")
    running = W.partitionBy(*cell).orderBy("n")
    best = best.select(*cell, "n", F.sum("league_points").over(running).alias("total"))
    plans = lineup.compositions(t.spark, OPENING_CAPS, OPENING).select("label", F.explode("counts").alias("short", "n"))
    wide = best.withColumn("short", F.substring("position", 1, 1)).join(plans, ["short", "n"])
    return wide.groupBy("league_key", "season", F.col("label").alias("strategy")).agg(
        F.round(F.sum("total"), 2).alias("opening_points")
    )


_SHORT_LABEL = " || ".join(f"CASE WHEN {x} > 0 THEN CAST({x} AS VARCHAR) || '{x.upper()}' ELSE '' END" for x in "abfh")


@query(
    "opening_strategies",
    f"""WITH {_PRICED}, {ENT}, {ROSTERS},
    sq AS (SELECT league_key, variant, season, region, draft_slot, string_agg(upper(substr(position, 1, 1)), '-' ORDER BY round) AS sequence
           FROM dealt WHERE round <= {OPENING} GROUP BY ALL),
    seats AS (SELECT res.league_key, res.strategy, sequence, points_vs_field FROM res JOIN sq USING (league_key, variant, season, region, draft_slot)
              WHERE is_actual),
    comp AS (SELECT a.n AS a, b.n AS b, f.n AS f, h.n AS h FROM range(0, 3) a(n), range(0, 6) b(n), range(0, 6) f(n), range(0, 3) h(n)
             WHERE a.n + b.n + f.n + h.n = 5),
    two AS (SELECT unnest(['B', 'F']) AS x),
    orders AS (SELECT a.x || '-' || b.x || '-' || c.x || '-' || d.x || '-' || e.x AS strategy FROM two a, two b, two c, two d, two e),
    plans AS (
      SELECT 'ADP' AS strategy, 'control' AS kind
      UNION ALL SELECT {_SHORT_LABEL}, 'composition' FROM comp
      UNION ALL SELECT strategy, 'ordering' FROM orders WHERE len(regexp_extract_all(strategy, 'B')) IN (2, 3)),
    hits AS (
      SELECT league_key, 'ADP' AS strategy, points_vs_field FROM seats
      UNION ALL SELECT league_key, strategy, points_vs_field FROM seats
      UNION ALL SELECT league_key, sequence, points_vs_field FROM seats)
    SELECT lg.league_key, plans.strategy, kind, count(points_vs_field) AS seats, round(avg(points_vs_field), 2) AS points_vs_field
    FROM plans CROSS JOIN lg LEFT JOIN hits ON hits.league_key = lg.league_key AND hits.strategy = plans.strategy GROUP BY ALL""",
)
def opening_strategies(t: Tables) -> DataFrame:
    """The control, the 36 openings and the 20 orders of the two headline openings, as drafted.

    A plan nobody drafted stays with no seats, so every league has the same 57 rows.
    """
    made = lineup.compositions(t.spark, OPENING_CAPS, OPENING).select(F.col("label").alias("strategy"), F.lit("composition").alias("kind"))
    for counts in HEADLINES:
        ordered = lineup.orderings(t.spark, counts)
        made = made.unionByName(ordered.select(F.col("sequence").alias("strategy"), F.lit("ordering").alias("kind")))
    control = t.spark.range(1).select(F.lit("ADP").alias("strategy"), F.lit("control").alias("kind"))
    plans = with_settings(made.unionByName(control), SETTINGS, ["league_key"])
    seats = opening_sequences(t)
    names = F.explode(F.array(F.lit("ADP"), "strategy", "sequence")).alias("strategy")
    hits = seats.select("league_key", names, "points_vs_field").groupBy("league_key", "strategy").agg(
        F.count("points_vs_field").alias("seats"), F.round(F.avg("points_vs_field"), 2).alias("points_vs_field")
    )
    return plans.join(hits, ["league_key", "strategy"], "left").withColumn("seats", F.coalesce("seats", F.lit(0)))


def opening_sequences(t: Tables) -> DataFrame:
    """Label, pick sequence and edge of every seat in each league's real format."""
    seat = [*TRIAL, "draft_slot"]
    picks = t.gold("rosters", lambda: rosters(t)).where(F.col("round") <= OPENING)
    short = F.substring("position", 1, 1)
    turns = picks.groupBy(*seat).agg(F.sort_array(F.collect_list(F.struct("round", short.alias("p")))).alias("o"))
    turns = turns.select(*seat, F.array_join("o.p", "-").alias("sequence"))
    actual = results(t).where("is_actual").select(*seat, "strategy", "points_vs_field")
    return actual.join(turns, seat).select("league_key", "strategy", "sequence", "points_vs_field")
