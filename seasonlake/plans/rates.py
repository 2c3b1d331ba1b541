"""Supplier seasons: weekly scoring, shrunk rates, component projections and their backtest.

entity = supplier, week = ship month, team = nation the supplier shipped to most.
"""

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions.fixed_values import RATE_GRID, TEAM_GRID
from seasonlake.functions.stats import mean_of
from seasonlake.operators.folds import fold_metrics, stack_predictions
from seasonlake.operators.history import stability_table, year_pairs
from seasonlake.operators import component
from seasonlake.operators.shrinkage import games_by_label, incumbency
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import ENT, L, O
from seasonlake.plans.registry import query
from seasonlake.session import pinned, sizes_measured

BACK = 3
MIN_GAMES = 6
FIRST_FOLD_AFTER = 4  # seasons of history before the first fold of the backtest
RATES = {
    "in10_rate": ("in10", "punts"), "in20_rate": ("in20", "punts"),
    "returned_rate": ("returned", "punts"), "touchback_rate": ("touchbacks", "punts"),
    "gross_average": ("yards", "punts"),
}
TEAM_RATES = {"team_volume": ("punts", "games")}
PRICES = {"in10_rate": 2.0, "in20_rate": 1.0, "returned_rate": -1.0, "touchback_rate": -0.5}
COUNTS = ("punts", "yards", "in10", "in20", "returned", "touchbacks", "games")
# The season ahead and the first fold follow the data, here and in the oracle texts.
UPCOMING = "(SELECT max(season) + 1 FROM ss)"
FIRST_FOLD = f"(SELECT min(season) + {FIRST_FOLD_AFTER} FROM ss)"


def model_of(seasons: DataFrame) -> component.Model:
    """The projection model with its seasons taken from the season table."""
    first, newest = seasons.agg(F.min("season"), F.max("season")).first()
    return component.Model(
        rates=RATES, prices=PRICES, flat_price=1.0, unit="punts", bonus="bonus", bonus_on="gross_average",
        counts=COUNTS, last=(newest or 0) + 1, first_fold=(first or 0) + FIRST_FOLD_AFTER, back=BACK,
        min_games=MIN_GAMES,
    )


def upcoming(seasons: DataFrame) -> Column:
    return seasons.agg((F.max("season") + 1).alias("m")).scalar()


#: Marks of a line, one bit each beside its week.
MARKS = ("in20", "_in10", "returned", "touchbacks")


def shipments(t: Tables) -> DataFrame:
    """(supplier, season, line): week and marks as one number, units, nation of the customer.

    All lines cross the network twice, to their orders and to their supplier's season, so
    rows are a few numbers wide; the nation's name comes to the counted cells.
    """
    orders = t.orders().select("order_id", F.col("entity_id").alias("c_custkey")).join(
        t.raw("customer").select("c_custkey", "c_nationkey"), "c_custkey"
    ).select("order_id", F.col("c_nationkey").alias("n_nationkey"))
    gained = F.when(F.col("return_flag") == "R", 2)
    marks = {
        "in20": F.col("discount_pct") <= 2,
        "_in10": 50 - F.col("units") + F.coalesce(gained, F.lit(0)) < 10,
        "returned": F.col("return_flag") == "R",
        "touchbacks": F.col("return_flag") == "A",
    }
    bits = sum((F.when(marks[m], 1 << i).otherwise(0) for i, m in enumerate(MARKS)), F.coalesce("week", F.lit(0)) * 16)
    lines = t.lines().select(
        "order_id", F.col("supplier_id").alias("entity_id"), "season", bits.alias("_line"), "units"
    )
    return lines.join(orders, "order_id").drop("order_id")


def weekly(t: Tables) -> DataFrame:
    """(supplier, season, week): counts, the capped derived count and weekly points."""
    week = ["entity_id", "season", "week"]
    number = F.shiftright("_line", 4)
    # one exchange: cells, weeks and seasons of a supplier's season are then made where it lies
    placed = shipments(t).repartition("entity_id", "season").withColumn("week", F.when(number > 0, number))
    cells = placed.groupBy(*week, "n_nationkey").agg(
        F.count(F.lit(1)).alias("punts"),
        F.sum("units").alias("yards"),
        *[F.count_if(F.col("_line").bitwiseAND(F.lit(1 << i)) > 0).alias(m) for i, m in enumerate(MARKS)],
    )
    nation = t.raw("nation").select("n_nationkey", F.col("n_name").alias("team"))
    sums = ("punts", "yards", *MARKS)
    cells = cells.join(F.broadcast(nation), "n_nationkey").groupBy(*week, "team").agg(*[F.sum(c).alias(c) for c in sums])
    # the week's team is the one shipped to most, taken in the same pass as the sums
    stats = cells.groupBy(*week).agg(
        F.min_by("team", F.struct(-F.col("punts"), F.col("team"))).alias("team"),
        *[F.sum(c).alias(c) for c in sums],
    )
    stats = stats.withColumn("in10", F.least("_in10", "in20")).drop("_in10")
    average = F.col("yards") / F.col("punts")
    bonus = F.when(average >= 30, 3.0).when(average >= 27, 2.0).when(average >= 25, 1.0).otherwise(0.0)
    return stats.withColumn("bonus", bonus).withColumn(
        "points",
        F.col("punts") * 1.0 + F.col("in10") * 2.0 + F.col("in20") * 1.0
        + F.col("returned") * -1.0 + F.col("touchbacks") * -0.5 + F.col("bonus"),
    )


def supplier_seasons(t: Tables) -> DataFrame:
    """Weekly points summed to seasons, with rates and the most frequent team."""
    sums = weekly(t).groupBy("entity_id", "season").agg(
        F.mode("team", deterministic=True).alias("team"),
        F.min_by("team", "week").alias("first_team"),
        F.count(F.lit(1)).alias("games"),
        *[F.sum(c).alias(c) for c in ("punts", "yards", "in10", "in20", "returned", "touchbacks", "points", "bonus")],
    )
    return sums


def seasons_table(t: Tables) -> DataFrame:
    with sizes_measured(t.spark):
        return t.gold("supplier_seasons", lambda: supplier_seasons(t))


WEEKLY = """sh AS (
    SELECT supplier_id AS entity_id, l.season, l.week, units, discount_pct, return_flag, team
    FROM l JOIN o USING (order_id) JOIN ent ON ent.entity_id = o.entity_id),
  tw AS (SELECT entity_id, season, week, team FROM (SELECT entity_id, season, week, team, count(*) AS n FROM sh GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY entity_id, season, week ORDER BY n DESC, team) = 1),
  w0 AS (
    SELECT entity_id, season, week, count(*) AS punts, CAST(sum(units) AS BIGINT) AS yards,
           count(*) FILTER (WHERE discount_pct <= 2) AS in20,
           least(count(*) FILTER (WHERE 50 - units + COALESCE(CASE WHEN return_flag = 'R' THEN 2 END, 0) < 10),
                 count(*) FILTER (WHERE discount_pct <= 2)) AS in10,
           count(*) FILTER (WHERE return_flag = 'R') AS returned, count(*) FILTER (WHERE return_flag = 'A') AS touchbacks
    FROM sh GROUP BY entity_id, season, week),
  wk AS (
    SELECT w0.*, team, CASE WHEN yards / punts >= 30 THEN 3.0 WHEN yards / punts >= 27 THEN 2.0
                            WHEN yards / punts >= 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS bonus
    FROM w0 JOIN tw USING (entity_id, season, week)),
  md AS (SELECT entity_id, season, team FROM (SELECT entity_id, season, team, count(*) AS n FROM wk GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY entity_id, season ORDER BY n DESC, team) = 1),
  ss AS (
    SELECT entity_id, season, any_value(md.team) AS team, arg_min(wk.team, week) AS first_team, count(*) AS games,
      CAST(sum(punts) AS BIGINT) AS punts, CAST(sum(yards) AS BIGINT) AS yards, CAST(sum(in10) AS BIGINT) AS in10,
      CAST(sum(in20) AS BIGINT) AS in20, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(touchbacks) AS BIGINT) AS touchbacks,
      CAST(sum(punts * 1.0 + in10 * 2.0 + in20 * 1.0 + returned * -1.0 + touchbacks * -0.5 + bonus) AS DOUBLE) AS points,
      CAST(sum(bonus) AS DOUBLE) AS bonus
    FROM wk JOIN md USING (entity_id, season) GROUP BY entity_id, season)"""
SEASONS = f"{O}, {ENT}, {L}, {WEEKLY}"


STABLE = ("points", "points_per_game", "punts_per_game", "gross_average", "net_average", "in20_rate", "in10_rate",
          "touchback_rate", "bonus_per_game", "returned_rate", "games")
_STABLE_SQL = """points, points / games AS points_per_game, punts / games AS punts_per_game, yards / punts AS gross_average,
      (yards - 5 * returned - 20 * touchbacks) / punts AS net_average, in20 / punts AS in20_rate, in10 / punts AS in10_rate,
      touchbacks / punts AS touchback_rate, bonus / games AS bonus_per_game, returned / punts AS returned_rate, CAST(games AS DOUBLE) AS games"""


@query(
    "season_stability",
    f"""WITH {SEASONS}, f AS (SELECT entity_id, season, {_STABLE_SQL} FROM ss WHERE games >= 6),
    p AS (SELECT {', '.join(f'a.{c}, b.{c} AS {c}_next' for c in STABLE)} FROM f a JOIN f b ON b.entity_id = a.entity_id AND b.season = a.season + 1)
    {' UNION ALL '.join(f"SELECT count(*) AS pairs, '{c}' AS stat, CASE WHEN max({c}) > min({c}) AND max({c}_next) > min({c}_next) THEN round(corr({c}, {c}_next), 6) END AS r FROM p" for c in STABLE)}""",
)
def season_stability(t: Tables) -> DataFrame:
    """Eleven season metrics against the same entity's next season."""
    c = F.col
    rates = {
        "points_per_game": c("points") / c("games"), "punts_per_game": c("punts") / c("games"), "gross_average": c("yards") / c("punts"),
        "net_average": (c("yards") - 5 * c("returned") - 20 * c("touchbacks")) / c("punts"), "in20_rate": c("in20") / c("punts"),
        "in10_rate": c("in10") / c("punts"), "touchback_rate": c("touchbacks") / c("punts"), "bonus_per_game": c("bonus") / c("games"),
        "returned_rate": c("returned") / c("punts"),
    }
    full = seasons_table(t).where(c("games") >= 6).withColumns(rates).withColumn("games", c("games").cast("double"))
    pairs = year_pairs(full.select("entity_id", "season", *STABLE), ["entity_id"], STABLE)
    return stability_table(pairs, STABLE).withColumn("r", F.round("r", 6))


@query(
    "scored_weeks",
    f"""WITH {SEASONS}
    SELECT entity_id, season, team, games, punts, points, points / games AS points_per_game,
      punts / games AS punts_per_game, yards / punts AS gross_average, in10 / punts AS in10_rate, in20 / punts AS in20_rate,
      returned / punts AS returned_rate, touchbacks / punts AS touchback_rate, bonus / games AS bonus_per_game FROM ss""",
)
def scored_weeks(t: Tables) -> DataFrame:
    """Points awarded week by week, then summed; rates over the season."""
    c = F.col
    return supplier_seasons(t).select(
        "entity_id", "season", "team", "games", "punts", "points",
        (c("points") / c("games")).alias("points_per_game"),
        (c("punts") / c("games")).alias("punts_per_game"),
        (c("yards") / c("punts")).alias("gross_average"),
        *[(c(n) / c(d)).alias(m) for m, (n, d) in RATES.items() if m != "gross_average"],
        (c("bonus") / c("games")).alias("bonus_per_game"),
    )


_RATE_VALUES = ", ".join(f"('{m}')" for m in RATES)
_ENTITY_PAIRS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, S, w_{n} AS num, w_{d} AS den, {n} / {d} AS y, punts AS w FROM ep"
    for m, (n, d) in RATES.items()
)
_PRIORS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, t.target, sum({n}) / sum({d}) AS prior FROM tg t JOIN ss ON season < t.target GROUP BY 1, 2"
    for m, (n, d) in {**RATES, **TEAM_RATES}.items()
)
_WSUMS = ", ".join(f"sum({c} * (11 - (S - season))) / 10.0 AS w_{c}" for c in COUNTS)
FIT = f"""tg AS (SELECT unnest(generate_series(min(season) + 1, max(season) + 1)) AS target FROM ss),
  hist AS (SELECT h.entity_id, tg.target AS S, {_WSUMS}, count(*) AS seasons_used FROM tg JOIN ss h
           ON h.season < tg.target AND tg.target - h.season <= 3 WHERE games >= {MIN_GAMES} GROUP BY 1, 2),
  tms AS (SELECT team, season, sum(punts) AS punts, sum(games) AS games FROM ss GROUP BY ALL),
  thist AS (SELECT h.team, tg.target AS S, sum(punts * (11 - (tg.target - season))) / 10.0 AS w_punts,
                   sum(games * (11 - (tg.target - season))) / 10.0 AS w_games FROM tg JOIN tms h
            ON h.season < tg.target AND tg.target - h.season <= 3 GROUP BY 1, 2),
  ep AS (SELECT hist.*, ss.punts, yards, in10, in20, returned, touchbacks FROM hist JOIN ss
         ON ss.entity_id = hist.entity_id AND ss.season = hist.S
         WHERE games >= {MIN_GAMES} AND hist.S >= (SELECT min(season) + 3 FROM ss)),
  pairs AS ({_ENTITY_PAIRS} UNION ALL
    SELECT 'team_volume', th.S, w_punts, w_games, punts / games, 1 FROM thist th JOIN tms ON tms.team = th.team AND tms.season = th.S
    WHERE th.S >= (SELECT min(season) + 3 FROM ss)),
  priors AS ({_PRIORS}),
  grid AS (SELECT metric, unnest({list(RATE_GRID)}) AS k FROM (VALUES {_RATE_VALUES}) v(metric)
           UNION ALL SELECT 'team_volume', unnest({list(TEAM_GRID)})),
  errs AS (
    SELECT p.metric, p.target, p.prior, g.k, count(*) AS n,
      sum(w * pow((num + g.k * prior) / (den + g.k) - y, 2)) / sum(w) AS err
    FROM priors p JOIN grid g ON g.metric = p.metric JOIN pairs x ON x.metric = p.metric AND x.S < p.target GROUP BY ALL),
  bestk AS (SELECT metric, target, k FROM errs WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY metric, target ORDER BY err, k) = 1),
  fit AS (SELECT p.metric, p.target, p.prior, COALESCE(k, CASE WHEN p.metric = 'team_volume' THEN {TEAM_GRID[len(TEAM_GRID) // 2]} ELSE {RATE_GRID[len(RATE_GRID) // 2]} END) AS k
          FROM priors p LEFT JOIN bestk USING (metric, target))"""
FIT = FIT.replace("(11 - (S - season))", "(11 - (tg.target - season))")


@query(
    "shrink_grid",
    f"""WITH {SEASONS}, {FIT}
    SELECT metric, CAST(target AS BIGINT) AS target_season, round(prior, 8) AS prior, CAST(k AS INT) AS k FROM fit""",
)
def shrink_grid(t: Tables) -> DataFrame:
    """The shrinkage strength that best predicted the next season, per fold."""
    seasons = seasons_table(t)
    fit = component.rate_fit(seasons, model_of(seasons))
    return fit.select(
        "metric", F.col("target_season").cast("long").alias("target_season"),
        F.round("prior", 8).alias("prior"), "k",
    )


def projections(seasons: DataFrame) -> DataFrame:
    """Every season on the roster and the upcoming one."""
    return component.project(seasons, roster(seasons), model_of(seasons))


def roster(seasons: DataFrame) -> DataFrame:
    """First team of a season; the newest one stands for the season ahead."""
    known = seasons.select("entity_id", "season", F.col("first_team").alias("team"))
    newest = seasons.agg(F.max("season").alias("m")).scalar()
    ahead = seasons.where(F.col("season") == newest).select(
        "entity_id", (F.col("season") + 1).alias("season"), F.col("first_team").alias("team")
    )
    return known.unionByName(ahead)


_SHRUNK = ", ".join(
    f"(COALESCE(hist.w_{n}, 0) + f_{m}.k * f_{m}.prior) / (COALESCE(hist.w_{d}, 0) + f_{m}.k) AS {m}"
    for m, (n, d) in RATES.items()
)
_FITJOINS = " ".join(
    f"JOIN fit f_{m} ON f_{m}.metric = '{m}' AND f_{m}.target = r.season" for m in [*RATES, "team_volume"]
)
_PER_PUNT = "1.0" + "".join(f" + {m} * {p}" for m, p in PRICES.items())
PROJ = f"""ros AS (
    SELECT entity_id, season, first_team AS team FROM ss UNION ALL
    SELECT entity_id, {UPCOMING}, first_team FROM ss WHERE season = (SELECT max(season) FROM ss)),
  lab AS (
    SELECT r.*, CASE WHEN p.team IS NULL THEN 'unproven' WHEN p.team = r.team THEN 'incumbent' ELSE 'new_team' END AS incumbency
    FROM ros r LEFT JOIN ss p ON p.entity_id = r.entity_id AND p.season = r.season - 1),
  gl AS (SELECT tg.target, incumbency, avg(games) AS g FROM tg JOIN lab ON lab.season < tg.target
         JOIN ss ON ss.entity_id = lab.entity_id AND ss.season = lab.season GROUP BY 1, 2),
  gp AS (SELECT tg.target, avg(games) AS g FROM tg JOIN ss ON ss.season < tg.target GROUP BY 1),
  eg AS (SELECT gp.target, v.incumbency, COALESCE(gl.g, gp.g) AS expected_games FROM gp
         CROSS JOIN (VALUES ('incumbent'), ('new_team'), ('unproven')) v(incumbency)
         LEFT JOIN gl ON gl.target = gp.target AND gl.incumbency = v.incumbency),
  ln AS (SELECT tg.target, regr_slope(bonus / games, yards / punts) AS slope, regr_intercept(bonus / games, yards / punts) AS intercept
         FROM tg JOIN ss ON ss.season < tg.target WHERE games >= {MIN_GAMES} GROUP BY 1),
  pj0 AS (
    SELECT r.season AS target_season, r.entity_id, r.team, r.incumbency, expected_games, slope, intercept,
      COALESCE(hist.seasons_used, 0) AS seasons_used, {_SHRUNK},
      (COALESCE(th.w_punts, 0) + f_team_volume.k * f_team_volume.prior) / (COALESCE(th.w_games, 0) + f_team_volume.k) AS team_volume
    FROM lab r JOIN eg ON eg.target = r.season AND eg.incumbency = r.incumbency JOIN ln ON ln.target = r.season {_FITJOINS}
    LEFT JOIN hist ON hist.entity_id = r.entity_id AND hist.S = r.season
    LEFT JOIN thist th ON th.team = r.team AND th.S = r.season),
  pj AS (
    SELECT *, expected_games * team_volume AS expected_punts, slope * gross_average + intercept AS bonus_per_game,
      expected_games * team_volume * ({_PER_PUNT}) + expected_games * (slope * gross_average + intercept) AS projected_points
    FROM pj0)"""


@query(
    "shrunk_rate",
    f"""WITH {SEASONS}, {FIT}, {PROJ}
    SELECT target_season, entity_id, seasons_used, {", ".join(f"round({m}, 6) AS {m}" for m in RATES)} FROM pj""",
)
def shrunk_rate(t: Tables) -> DataFrame:
    """Each supplier's rates pulled toward the league by the fitted strength."""
    df = projections(seasons_table(t))
    return df.select(
        "target_season", "entity_id", "seasons_used", *[F.round(m, 6).alias(m) for m in RATES]
    )


@query(
    "incumbency_games",
    f"""WITH {SEASONS}, {FIT}, {PROJ}
    SELECT CAST(target AS BIGINT) AS target_season, incumbency, round(expected_games, 8) AS expected_games FROM eg""",
)
def incumbency_games(t: Tables) -> DataFrame:
    """Expected games by how settled the job is, from earlier seasons."""
    seasons = seasons_table(t)
    roster = seasons.select("entity_id", "season", F.col("first_team").alias("team"), "games")
    labelled = incumbency(roster, seasons.select("entity_id", "season", "team"))
    out = games_by_label(labelled, upcoming(seasons))
    return out.select(
        F.col("target_season").cast("long").alias("target_season"), "incumbency",
        F.round("expected_games", 8).alias("expected_games"),
    )


@query(
    "component_projection",
    f"""WITH {SEASONS}, {FIT}, {PROJ},
    feed AS (SELECT s_suppkey AS entity_id, nullif(CASE WHEN s_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END, 0.0) AS external FROM supplier)
    SELECT target_season, pj.entity_id, team, incumbency, round(expected_games, 6) AS expected_games,
      round(expected_punts, 6) AS expected_punts, round(projected_points, 6) AS projected_points, external,
      round(CASE WHEN external IS NULL THEN projected_points ELSE (projected_points + external) / 2 END, 6) AS blended
    FROM pj LEFT JOIN feed ON feed.entity_id = pj.entity_id WHERE target_season = {UPCOMING}""",
)
def component_projection(t: Tables) -> DataFrame:
    """The upcoming season from its components, beside an outside number where 0 means absent."""
    seasons = seasons_table(t)
    df = projections(seasons).where(F.col("target_season") == upcoming(seasons))
    said = F.when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(F.col("s_acctbal"))
    feed = t.raw("supplier").select(
        F.col("s_suppkey").alias("entity_id"), F.nullif(said, F.lit(0.0)).alias("external")
    )
    df = df.join(feed, "entity_id", "left")
    blended = mean_of([F.col("projected_points"), F.col("external")])
    return df.select(
        "target_season", "entity_id", "team", "incumbency",
        *[F.round(c, 6).alias(c) for c in ("expected_games", "expected_punts", "projected_points")],
        "external", F.round(blended, 6).alias("blended"),
    )


PREDICTIONS = {p: p for p in ("model", "prior_points", "prior_ppg", "league_mean")}


def backtest(t: Tables) -> DataFrame:
    seasons = seasons_table(t)
    folds = pinned(component.backtest_folds(seasons, roster(seasons), model_of(seasons)))
    long = stack_predictions(folds, ["target_season", "entity_id", "actual"], PREDICTIONS)
    return fold_metrics(long, ("target_season", "prediction"), "actual", "predicted", "entity_id")


def backtest_table(t: Tables) -> DataFrame:
    """``backtest``, stored; its plans join seasons to seasons many times over."""
    with sizes_measured(t.spark):
        return t.gold("backtest", lambda: backtest(t))


FOLDS = f"""fm AS (SELECT tg.target, avg(points) AS league_mean FROM tg JOIN ss ON ss.season < tg.target WHERE games >= {MIN_GAMES} GROUP BY 1),
  mg AS (SELECT target, avg(expected_games) AS mean_games FROM eg GROUP BY 1),
  fo AS (
    SELECT pj.target_season, pj.entity_id, a.points AS actual, round(projected_points, 6) AS model, round(league_mean, 6) AS league_mean,
      round(COALESCE(p.points, league_mean), 6) AS prior_points, round(COALESCE(p.points / p.games * mean_games, league_mean), 6) AS prior_ppg
    FROM pj JOIN fm ON fm.target = pj.target_season JOIN mg ON mg.target = pj.target_season
    JOIN ss a ON a.entity_id = pj.entity_id AND a.season = pj.target_season
    LEFT JOIN ss p ON p.entity_id = pj.entity_id AND p.season = pj.target_season - 1
    WHERE pj.target_season >= {FIRST_FOLD}),
  lo AS ({" UNION ALL ".join(f"SELECT target_season, '{p}' AS prediction, entity_id, actual, {p} AS predicted FROM fo" for p in PREDICTIONS)}),
  lr AS (SELECT *,
      rank() OVER (PARTITION BY target_season, prediction ORDER BY predicted) + (count(*) OVER (PARTITION BY target_season, prediction, predicted) - 1) / 2.0 AS r1,
      rank() OVER (PARTITION BY target_season, prediction ORDER BY actual) + (count(*) OVER (PARTITION BY target_season, prediction, actual) - 1) / 2.0 AS r2,
      row_number() OVER (PARTITION BY target_season, prediction ORDER BY predicted DESC, entity_id) AS n1,
      row_number() OVER (PARTITION BY target_season, prediction ORDER BY actual DESC, entity_id) AS n2 FROM lo),
  bt AS (
    SELECT target_season, prediction, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse,
      1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2,
      CASE WHEN max(predicted) > min(predicted) THEN corr(r1, r2) END AS spearman,
      CASE WHEN max(predicted) > min(predicted) THEN count(*) FILTER (WHERE n1 <= 5 AND n2 <= 5) END AS top5_hits,
      CASE WHEN max(predicted) > min(predicted) THEN count(*) FILTER (WHERE n1 <= 10 AND n2 <= 10) END AS top10_hits
    FROM lr GROUP BY target_season, prediction)"""
BACKTEST = f"{SEASONS}, {FIT}, {PROJ}, {FOLDS}"


@query(
    "fold_metrics",
    f"""WITH {BACKTEST}
    SELECT target_season, prediction, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
           round(spearman, 6) AS spearman, top5_hits, top10_hits FROM bt""",
)
def fold_metrics_query(t: Tables) -> DataFrame:
    """Walk-forward backtest of the projection and three naive predictions."""
    df = backtest_table(t)
    return df.select(
        "target_season", "prediction", "n",
        *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2", "spearman")],
        "top5_hits", "top10_hits",
    )
