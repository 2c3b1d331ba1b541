"""Calibration, bins, cell statistics and role exposure."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions.fixed_values import OUTCOME_RATES
from seasonlake.functions.stats import coverage_metrics
from seasonlake.operators import learn
from seasonlake.operators.folds import backtest_table, games_metrics, quantile_bins, top_hits
from seasonlake.operators.history import before_season, slice_means
from seasonlake.operators.outcomes import archetype_outcomes
from seasonlake.plans.baselines import BASELINE, baseline, season_metrics
from seasonlake.plans.bindings import Tables
from seasonlake.plans.consensus import _PRICED
from seasonlake.plans.leagues import REFERENCE
from seasonlake.plans.oracle_parts import ENT, O
from seasonlake.plans.outcomes import ASKING, asking_prices
from seasonlake.plans.registry import query
from seasonlake.plans.value import ARCHETYPE, FULL_VALUE, archetype_frame, unranked_surplus
from seasonlake.session import pinned



def predicted_rates(t: Tables) -> DataFrame:
    """Baseline rate beside the realised rate."""
    said = baseline(t).select("entity_id", "target_season", F.round("weighted_ppg", 0).cast("long").alias("predicted"))
    did = season_metrics(t).where(F.col("games") >= 2).select(
        "entity_id", F.col("season").alias("target_season"), F.col("ppg").alias("actual")
    )
    people = t.entities().select("entity_id", "position")
    return pinned(said.join(did, ["entity_id", "target_season"]).join(people, "entity_id"))


PREDICTED = """pq AS (
    SELECT bl.entity_id, target_season, position, CAST(round(weighted_ppg, 0) AS BIGINT) AS predicted, m.ppg AS actual
    FROM bl JOIN m ON m.entity_id = bl.entity_id AND m.season = bl.target_season AND m.games >= 2 JOIN ent ON ent.entity_id = bl.entity_id),
  pr5 AS (SELECT *, ntile(5) OVER (PARTITION BY target_season ORDER BY predicted, entity_id) AS quintile FROM pq),
  rs AS (
    SELECT t.target_season AS season, p.position, p.quintile,
      quantile_cont(p.actual - p.predicted, 0.1) AS q10, quantile_cont(p.actual - p.predicted, 0.9) AS q90
    FROM (SELECT DISTINCT target_season FROM pr5) t JOIN pr5 p ON p.target_season < t.target_season GROUP BY ALL),
  iv AS (SELECT pr5.*, predicted + round(q10, 2) AS p10, predicted + round(q90, 2) AS p90 FROM pr5
         JOIN rs ON rs.season = pr5.target_season AND rs.position = pr5.position AND rs.quintile = pr5.quintile)"""


def intervals(t: Tables) -> DataFrame:
    """p10 and p90 from the residuals of earlier folds in the same cell."""
    made = learn.residual_intervals(predicted_rates(t), "actual", "predicted", "entity_id", digits=2)
    return made.where(F.col("p10").isNotNull())


@query(
    "coverage",
    f"""WITH {O}, {ENT}, {BASELINE}, {PREDICTED}
    SELECT target_season, count(*) AS n, round(avg(CAST(actual <= p10 AS DOUBLE)), 8) AS below_low,
      round(avg(CAST(actual <= p90 AS DOUBLE)), 8) AS below_high, count(*) FILTER (WHERE p90 < p10) AS crossed
    FROM iv GROUP BY target_season""",
)
def coverage(t: Tables) -> DataFrame:
    """Do the intervals hold what they claim, fold by fold?"""
    made = coverage_metrics(F.col("actual"), F.col("p10"), F.col("p90"))
    return intervals(t).groupBy("target_season").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(made["below_low"], 8).alias("below_low"),
        F.round(made["below_high"], 8).alias("below_high"),
        made["crossed"].alias("crossed"),
    )


def _ranks(*columns: str) -> str:
    part = "PARTITION BY target_season, position"
    return ", ".join(
        f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part}, {c}) - 1) / 2.0 AS r_{c}" for c in columns
    )


@query(
    "benchmark_metrics",
    f"""WITH {_PRICED}, {ENT}, {ASKING}, {BASELINE}, {PREDICTED},
    sc0 AS (SELECT pq.entity_id, target_season, pq.position, actual, predicted, ask.price AS market, m.ppg AS naive
            FROM pq LEFT JOIN ask ON ask.entity_id = pq.entity_id AND ask.season = pq.target_season
            LEFT JOIN m ON m.entity_id = pq.entity_id AND m.season = pq.target_season - 1),
    sc1 AS (SELECT * REPLACE (COALESCE(naive, predicted) AS naive) FROM sc0),
    nb0 AS (SELECT m.entity_id, m.season AS target_season, position, CASE WHEN m.games >= 2 THEN m.ppg END AS actual,
              (SELECT round(sum(p.ppg * p.games) * 1.0 / sum(p.games), 4) FROM m p WHERE p.entity_id = m.entity_id AND p.season < m.season) AS career
            FROM m JOIN ent ON ent.entity_id = m.entity_id LEFT JOIN bl ON bl.entity_id = m.entity_id AND bl.target_season = m.season
            WHERE bl.entity_id IS NULL),
    nb1 AS (SELECT nb0.*, round(COALESCE(
              (SELECT sum(s.actual) * 1.0 / count(s.actual) FROM nb0 s WHERE s.position = nb0.position AND s.target_season < nb0.target_season),
              (SELECT sum(s.actual) * 1.0 / count(s.actual) FROM nb0 s WHERE s.target_season < nb0.target_season)), 4) AS naive FROM nb0),
    nb AS (SELECT nb1.entity_id, target_season, 'NO_BASELINE' AS position, actual, COALESCE(career, naive) AS predicted, ask.price AS market, naive
           FROM nb1 LEFT JOIN ask ON ask.entity_id = nb1.entity_id AND ask.season = nb1.target_season
           WHERE actual IS NOT NULL AND naive IS NOT NULL AND NOT isnan(naive)),
    sc2 AS (SELECT * FROM sc1 UNION ALL SELECT * REPLACE ('ALL' AS position) FROM sc1 UNION ALL SELECT * FROM nb),
    ma AS (SELECT *, {_ranks("actual", "predicted", "naive")} FROM sc2),
    mb AS (SELECT *, {_ranks("actual", "predicted", "market")} FROM sc2 WHERE market IS NOT NULL),
    fa AS (SELECT target_season, position, count(*) AS n, avg(abs(actual - predicted)) AS mae,
             1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2, corr(r_predicted, r_actual) AS spearman,
             avg(abs(actual - naive)) AS naive_mae, corr(r_naive, r_actual) AS naive_spearman FROM ma GROUP BY ALL),
    fb AS (SELECT target_season, position, count(*) AS market_n, -corr(r_market, r_actual) AS market_spearman,
             corr(r_predicted, r_actual) AS model_spearman_vs_market FROM mb GROUP BY ALL HAVING count(*) >= 20),
    ga AS (SELECT bl.target_season, 'ALL' AS position, count(*) AS games_n,
             avg(abs(COALESCE(d.games, 0) - COALESCE(p.games, weighted_games_per_season))) AS games_mae,
             avg(abs(COALESCE(d.games, 0) - weighted_games_per_season)) AS games_naive_mae
           FROM bl JOIN ent ON ent.entity_id = bl.entity_id LEFT JOIN m d ON d.entity_id = bl.entity_id AND d.season = bl.target_season
           LEFT JOIN m p ON p.entity_id = bl.entity_id AND p.season = bl.target_season - 1
           WHERE bl.target_season <= (SELECT max(season) FROM m) GROUP BY ALL)
    SELECT target_season, position, n, round(mae, 4) AS mae, round(r2, 6) AS r2, round(spearman, 6) AS spearman, round(naive_mae, 4) AS naive_mae,
      round(naive_spearman, 6) AS naive_spearman, market_n, round(market_spearman, 6) AS market_spearman,
      round(model_spearman_vs_market, 6) AS model_spearman_vs_market, games_n, round(games_mae, 4) AS games_mae,
      round(games_naive_mae, 4) AS games_naive_mae
    FROM fa LEFT JOIN fb USING (target_season, position) LEFT JOIN ga USING (target_season, position) WHERE n >= 20 OR position = 'ALL'""",
)
def benchmark_metrics_query(t: Tables) -> DataFrame:
    """The baseline against carrying last season forward and against the market, fold by fold.

    Newcomers have a row of their own against the position's mean of the training slice,
    and each fold says how far games were off, over everyone with a baseline.
    """
    key = ["entity_id", "target_season"]
    metrics = pinned(season_metrics(t).withColumnRenamed("season", "target_season"))
    said = baseline(t)
    people = t.entities().select("entity_id", "position")
    market = asking_prices(t).select("entity_id", F.col("season").alias("target_season"), F.col("price").alias("market"))
    last = metrics.select("entity_id", (F.col("target_season") + 1).alias("target_season"), F.col("ppg").alias("naive"), F.col("games").alias("_before"))
    columns = [*key, "position", "actual", "predicted", "naive", "market"]
    df = t.gold("predicted", lambda: predicted_rates(t)).join(market, key, "left").join(last.drop("_before"), key, "left")
    df = df.withColumn("naive", F.coalesce("naive", F.col("predicted").cast("double"))).select(*columns)

    earlier = before_season(["entity_id"], "target_season")
    career = F.sum(F.col("ppg") * F.col("games")).over(earlier) / F.sum("games").over(earlier)
    fresh = metrics.select(
        *key, F.when(F.col("games") >= 2, F.col("ppg")).alias("actual"), F.round(career, 4).alias("_career")
    ).join(said.select(*key), key, "left_anti").join(people, "entity_id")
    fresh = pinned(fresh)
    means = slice_means(fresh, ["position"], "actual", "naive", "target_season").withColumn("naive", F.round("naive", 4))
    fresh = fresh.join(means, ["position", "target_season"]).where(F.col("actual").isNotNull()).join(market, key, "left")
    fresh = fresh.withColumn("predicted", F.coalesce("_career", "naive")).select(*columns)

    newest = metrics.agg(F.max("target_season").alias("m")).scalar()
    played = said.where(F.col("target_season") <= newest).join(people.select("entity_id"), "entity_id").join(
        metrics.select(*key, "games"), key, "left"
    ).join(last.drop("naive"), key, "left")
    played = played.withColumn("_games", F.coalesce("games", F.lit(0))).withColumn(
        "_said", F.coalesce(F.col("_before").cast("double"), F.col("weighted_games_per_season"))
    )
    availability = games_metrics(played, ["target_season"], "_games", "_said", "weighted_games_per_season")
    out = backtest_table(
        pinned(df), fresh, availability, ["target_season"], "position", "actual", "predicted", "naive", "market", "entity_id"
    )
    digits = {"mae": 4, "naive_mae": 4, "games_mae": 4, "games_naive_mae": 4}
    return out.select(*[
        F.round(c, digits.get(c, 6)).alias(c) if kind == "double" else c for c, kind in out.dtypes
    ])


@query(
    "top_n_hits",
    f"""WITH {O}, {ENT}, {BASELINE}, {PREDICTED},
    r AS (SELECT *, row_number() OVER (PARTITION BY target_season, position ORDER BY predicted DESC, entity_id) AS a,
            row_number() OVER (PARTITION BY target_season, position ORDER BY actual DESC, entity_id) AS b FROM pq)
    SELECT target_season, position, count(*) FILTER (WHERE a <= 25 AND b <= 25) AS hits FROM r GROUP BY ALL""",
)
def top_n_hits(t: Tables) -> DataFrame:
    """Predicted top 25 that finished in the realised top 25, per season and position."""
    df, cell = t.gold("predicted", lambda: predicted_rates(t)), ["target_season", "position"]
    hits = top_hits(df, cell, "predicted", "actual", "entity_id", {"hits": 25})
    groups = df.select(*cell).distinct()
    return groups.join(hits, cell, "left").na.fill(0, ["hits"])


_EDGES = ", ".join(f"quantile_cont(projected_surplus, {i / 10}) AS e{i}" for i in range(11))


@query(
    "decile_table",
    f"""WITH {FULL_VALUE},
    bd AS (SELECT * FROM dv WHERE league_key = '{REFERENCE}' AND surplus_value IS NOT NULL AND projected_surplus IS NOT NULL),
    ee AS (SELECT {_EDGES} FROM bd),
    l AS (SELECT list_distinct([{", ".join(f"e{i}" for i in range(11))}]) AS edges FROM ee),
    d AS (SELECT bd.*, greatest(len(list_filter(edges, lambda x: x < projected_surplus)), 1) AS bin FROM bd CROSS JOIN l)
    SELECT bin, count(*) AS n, round(avg(projected_surplus), 2) AS mean_projected, round(avg(surplus_value), 2) AS mean_realised,
      round(avg(CAST(surplus_value > 0 AS DOUBLE)), 8) AS beat_price FROM d GROUP BY bin""",
)
def decile_table(t: Tables) -> DataFrame:
    """Realised surplus by decile of the preseason call."""
    df = unranked_surplus(t).where(
        (F.col("league_key") == REFERENCE) & F.col("surplus_value").isNotNull() & F.col("projected_surplus").isNotNull()
    )
    return quantile_bins(df, "projected_surplus", 10).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("projected_surplus"), 2).alias("mean_projected"),
        F.round(F.avg("surplus_value"), 2).alias("mean_realised"),
        F.round(F.avg((F.col("surplus_value") > 0).cast("double")), 8).alias("beat_price"),
    )


_RATE_SQL = ", ".join(
    f"round(avg(CAST(outcome_bucket = '{bucket}' AS DOUBLE)), 8) AS {name}" for bucket, name in OUTCOME_RATES.items()
)
CELLS = f"""ce0 AS (
    SELECT league_key, position, archetype, count(*) AS n, count(surplus_centered) AS n_scored, round(avg(price), 3) AS mean_price,
      round(avg(CAST(is_elite_finish AS DOUBLE)), 8) AS elite_finish_rate, avg(surplus_centered) AS mean_surplus,
      stddev_samp(surplus_centered) / sqrt(count(surplus_centered)) AS surplus_se,
      round(avg(CAST(surplus_centered > 0 AS DOUBLE)), 8) AS surplus_positive_rate, {_RATE_SQL}
    FROM af WHERE outcome_bucket IS NOT NULL GROUP BY ALL),
  se AS (SELECT league_key, position, archetype, count(*) FILTER (WHERE m > 0) AS seasons_positive, count(*) AS seasons_measured
         FROM (SELECT league_key, position, archetype, season, avg(surplus_centered) AS m FROM af
               WHERE outcome_bucket IS NOT NULL AND surplus_centered IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  ce AS (
    SELECT ce0.*, COALESCE(seasons_positive, 0) AS seasons_positive, COALESCE(seasons_measured, 0) AS seasons_measured,
      mean_surplus / nullif(surplus_se, 0) AS surplus_t FROM ce0 LEFT JOIN se USING (league_key, position, archetype)),
  cg AS (SELECT ce.*, COALESCE(r.ok, false) AS is_reliable FROM ce LEFT JOIN (
           SELECT position, archetype, n_scored >= 20 AND abs(surplus_t) >= 1.0 AS ok FROM ce WHERE league_key = '{REFERENCE}') r
           USING (position, archetype))"""


def cell_table(t: Tables) -> DataFrame:
    frame = t.gold("archetypes", lambda: archetype_frame(t))
    return archetype_outcomes(frame, REFERENCE, min_rows=20, min_t=1.0)


@query(
    "archetype_rates",
    f"""WITH {ARCHETYPE}, {CELLS}
    SELECT * EXCLUDE (mean_surplus, surplus_se, surplus_t), round(mean_surplus, 2) AS mean_surplus, round(surplus_se, 2) AS surplus_se,
      round(surplus_t, 6) AS surplus_t, round(CASE WHEN is_reliable THEN mean_surplus ELSE 0.0 END, 2) AS archetype_edge FROM cg""",
)
def archetype_rates(t: Tables) -> DataFrame:
    """Outcome rates and the gated edge per league, position and class."""
    digits = {"mean_surplus": 2, "surplus_se": 2, "surplus_t": 6, "archetype_edge": 2, "mean_price": 3}
    df = cell_table(t)
    return df.select(*[
        F.round(c, digits.get(c, 8)).alias(c) if kind == "double" else c for c, kind in df.dtypes
    ])


@query(
    "role_exposure",
    f"""WITH {O}, {ENT}, {BASELINE},
    s AS (SELECT entity_id, season, max(CASE WHEN source = '1-URGENT' THEN 1 ELSE 0 END) AS is_starter FROM o WHERE week <= 2 GROUP BY ALL),
    f AS (SELECT bl.entity_id, bl.target_season, position, weighted_games_per_season AS expected, COALESCE(is_starter, 0) AS is_starter
          FROM bl JOIN ent USING (entity_id) LEFT JOIN s ON s.entity_id = bl.entity_id AND s.season = bl.target_season),
    r AS (SELECT target_season, position, avg(expected) AS ref FROM f WHERE is_starter = 1 GROUP BY ALL)
    SELECT f.entity_id, f.target_season, f.position, is_starter,
      round(12 * COALESCE(CASE WHEN expected / ref IS NOT NULL THEN least(expected / ref, 1.0) END, 1.0), 6) AS role_games
    FROM f LEFT JOIN r USING (target_season, position)""",
)
def role_exposure(t: Tables) -> DataFrame:
    """Expected games against the mean of listed starters, capped at a full season."""
    listed = t.orders().where(F.col("week") <= 2).groupBy("entity_id", F.col("season").alias("target_season")).agg(
        F.max((F.col("source") == "1-URGENT").cast("int")).alias("is_starter")
    )
    df = baseline(t).select("entity_id", "target_season", F.col("weighted_games_per_season").alias("expected"))
    df = df.join(t.entities().select("entity_id", "position"), "entity_id")
    df = df.join(listed, ["entity_id", "target_season"], "left").withColumn(
        "is_starter", F.coalesce("is_starter", F.lit(0))
    )
    out = learn.role_games(
        df.withColumn("season_games", F.lit(12)), "expected", "is_starter", "season_games",
        ["target_season", "position"],
    )
    return out.select(
        "entity_id", "target_season", "position", "is_starter",
        F.round("role_games", 6).alias("role_games"),
    )
