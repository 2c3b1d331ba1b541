"""Named reports over the derived tables."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.functions.stats import correlation
from seasonlake.operators.ranking import group_percentiles, top_k, with_rank
from seasonlake.plans.baselines import BASELINE
from seasonlake.plans.bindings import Tables
from seasonlake.plans.consensus import _PRICED
from seasonlake.plans.folds import CELLS, PREDICTED, cell_table, predicted_rates
from seasonlake.plans.leagues import REFERENCE
from seasonlake.plans.oracle_parts import ENT, O
from seasonlake.plans.outcomes import ASKING, BUCKETS, CHART, POR, buckets, over_replacement
from seasonlake.plans.rates import (
    BACKTEST, FIT, PREDICTIONS, PROJ, SEASONS, UPCOMING, backtest_table, projections, seasons_table, upcoming,
)
from seasonlake.plans.registry import query
from seasonlake.plans.strategy import (
    OPENING, ROSTERS, STRATEGY, opening_sequences, results, summary,
)
from seasonlake.plans.value import ARCHETYPE, FULL_VALUE, archetype_frame, unranked_surplus


def surplus(t: Tables) -> DataFrame:
    return unranked_surplus(t)


def archetypes(t: Tables) -> DataFrame:
    return t.gold("archetypes", lambda: archetype_frame(t))


def bucket_table(t: Tables) -> DataFrame:
    return t.gold("buckets", lambda: buckets(t))


def mean_of(column: str, digits: int, name: str | None = None):
    return F.round(F.avg(column), digits).alias(name or column)


def rate(predicate, name: str):
    return F.round(F.avg(predicate.cast("double")), 8).alias(name)


STEP = 40.0


@query(
    "report_surplus_by_round",
    f"""WITH {FULL_VALUE}
    SELECT CAST(floor(price / {STEP}) AS BIGINT) + 1 AS round, count(*) AS n, round(avg(expected_value), 2) AS mean_expected,
      round(avg(actual_value), 2) AS mean_actual, round(avg(CAST(surplus_value > 0 AS DOUBLE)), 8) AS hit
    FROM dv WHERE league_key = '{REFERENCE}' AND surplus_value IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
def report_surplus_by_round(t: Tables) -> DataFrame:
    """Expected and actual value by draft round."""
    df = surplus(t).where((F.col("league_key") == REFERENCE) & F.col("surplus_value").isNotNull())
    step = (F.floor(F.col("price") / STEP) + 1).cast("long").alias("round")
    return df.groupBy(step).agg(
        F.count(F.lit(1)).alias("n"), mean_of("expected_value", 2, "mean_expected"),
        mean_of("actual_value", 2, "mean_actual"), rate(F.col("surplus_value") > 0, "hit"),
    ).orderBy("round")


_PARTS = {"punts": "punts", "games": "games", "punts_per_game": "punts / games", "in10_rate": "in10 / punts",
          "in20_rate": "in20 / punts", "gross_average": "yards / punts", "touchback_rate": "touchbacks / punts"}


@query(
    "report_same_season",
    f"WITH {SEASONS}, w AS (SELECT * FROM ss WHERE games >= 6) "
    + " UNION ALL ".join(f"SELECT '{n}' AS component, round(corr(points, {e}), 6) AS r FROM w" for n, e in _PARTS.items()),
)
def report_same_season(t: Tables) -> DataFrame:
    """What goes with season points in the same season."""
    df = seasons_table(t).where(F.col("games") >= 6)
    wide = df.agg(*[correlation(F.col("points"), F.expr(e)).alias(n) for n, e in _PARTS.items()])
    stacked = ", ".join(f"'{n}', `{n}`" for n in _PARTS)
    long = wide.selectExpr(f"stack({len(_PARTS)}, {stacked}) AS (component, r)")
    return long.select("component", F.round("r", 6).alias("r")).orderBy(F.abs("r").desc_nulls_last())


@query(
    "report_backtest_pooled",
    f"""WITH {BACKTEST}
    SELECT prediction, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(spearman), 6) AS rank_r,
      CAST(sum(top10_hits) AS BIGINT) AS top10_hits, count(*) * 10 AS top10_of, count(*) AS seasons FROM bt GROUP BY prediction""",
)
def report_backtest_pooled(t: Tables) -> DataFrame:
    """Every prediction averaged over its folds."""
    return backtest_table(t).groupBy("prediction").agg(
        mean_of("mae", 6), mean_of("rmse", 6), mean_of("spearman", 6, "rank_r"),
        F.sum("top10_hits").alias("top10_hits"), (F.count(F.lit(1)) * 10).alias("top10_of"),
        F.count(F.lit(1)).alias("seasons"),
    )


@query(
    "report_backtest_pivot",
    f"WITH {BACKTEST} SELECT target_season, "
    + ", ".join(f"round(max(CASE WHEN prediction = '{p}' THEN mae END), 6) AS {p}" for p in PREDICTIONS)
    + " FROM bt GROUP BY target_season",
)
def report_backtest_pivot(t: Tables) -> DataFrame:
    """Mean absolute error, season by prediction."""
    df = backtest_table(t)
    return df.groupBy("target_season").pivot("prediction", list(PREDICTIONS)).agg(F.round(F.max("mae"), 6))


@query(
    "report_archetype_verdict",
    f"""WITH {ARCHETYPE}, {CELLS}
    SELECT position, archetype, n_scored, mean_price, round(mean_surplus, 2) AS mean_surplus, surplus_positive_rate, seasons_positive, seasons_measured,
      CASE WHEN is_reliable AND mean_surplus < 0 THEN 'AVOID' WHEN is_reliable THEN 'EDGE' ELSE 'not distinguishable from zero' END AS verdict
    FROM cg WHERE league_key = '{REFERENCE}'""",
)
def report_archetype_verdict(t: Tables) -> DataFrame:
    """The grid on the reference league with a verdict per cell."""
    reliable, low = F.col("is_reliable"), F.col("mean_surplus") < 0
    verdict = F.when(reliable & low, "AVOID").when(reliable, "EDGE").otherwise("not distinguishable from zero")
    return cell_table(t).where(F.col("league_key") == REFERENCE).select(
        "position", "archetype", "n_scored", F.round("mean_price", 3).alias("mean_price"),
        F.round("mean_surplus", 2).alias("mean_surplus"),
        F.round("surplus_positive_rate", 8).alias("surplus_positive_rate"),
        "seasons_positive", "seasons_measured", verdict.alias("verdict"),
    )


@query(
    "report_edge_check",
    f"""WITH {ARCHETYPE}
    SELECT CAST(sign(archetype_edge) AS INT) AS direction, count(*) AS n, round(avg(surplus_centered), 2) AS realised,
      round(avg(CAST(is_elite_finish AS DOUBLE)), 8) AS elite FROM af
    WHERE archetype_edge IS NOT NULL AND surplus_centered IS NOT NULL GROUP BY 1""",
)
def report_edge_check(t: Tables) -> DataFrame:
    """Realised surplus of rows marked up, down or neither."""
    df = archetypes(t).where(F.col("archetype_edge").isNotNull() & F.col("surplus_centered").isNotNull())
    return df.groupBy(F.signum("archetype_edge").cast("int").alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), mean_of("surplus_centered", 2, "realised"),
        rate(F.col("is_elite_finish"), "elite"),
    )


@query(
    "report_live_board",
    f"""WITH {ARCHETYPE}
    SELECT entity_id, position, price, age, experience, prior_elite, archetype, round(archetype_edge, 2) AS archetype_edge FROM af
    WHERE league_key = '{REFERENCE}' AND season = (SELECT max(season) FROM af) ORDER BY price, entity_id LIMIT 25""",
)
def report_live_board(t: Tables) -> DataFrame:
    """The newest board's first 25 by price."""
    df = archetypes(t)
    newest = df.agg(F.max("season").alias("m")).scalar()
    live = df.where((F.col("season") == newest) & (F.col("league_key") == REFERENCE))
    return live.orderBy("price", "entity_id").limit(25).select(
        "entity_id", "position", "price", F.col("age_at_season").alias("age"),
        F.col("seasons_of_experience").alias("experience"), "prior_elite", "archetype",
        F.round("archetype_edge", 2).alias("archetype_edge"),
    )


_CURVE = f"""cv AS (
    SELECT league_key, position_rank AS rank,
      max(CASE WHEN position = 'AUTOMOBILE' THEN por END) AS automobile, max(CASE WHEN position = 'BUILDING' THEN por END) AS building,
      max(CASE WHEN position = 'FURNITURE' THEN por END) AS furniture, max(CASE WHEN position = 'HOUSEHOLD' THEN por END) AS household
    FROM (SELECT league_key, position, position_rank, round(avg(points_over_replacement), 2) AS por FROM por WHERE position_rank <= 30 GROUP BY ALL)
    GROUP BY ALL)"""


def scarcity(t: Tables) -> DataFrame:
    """Mean value of each finishing place, one column per position."""
    df = over_replacement(t).where(F.col("position_rank") <= 30)
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    wide = df.groupBy("league_key", F.col("position_rank").alias("rank")).pivot("position", names).agg(
        F.round(F.avg("points_over_replacement"), 2)
    )
    return wide.select("league_key", "rank", *[F.col(n).alias(n.lower()) for n in names])


@query("report_scarcity_curve", f"WITH {O}, {ENT}, {POR}, {_CURVE} SELECT *, round(building - furniture, 2) AS premium FROM cv")
def report_scarcity_curve(t: Tables) -> DataFrame:
    """What a finish at each place is worth, and the premium between two positions."""
    return scarcity(t).withColumn("premium", F.round(F.col("building") - F.col("furniture"), 2))


@query(
    "report_crossover",
    f"""WITH {O}, {ENT}, {POR}, {_CURVE}
    SELECT league_key, CAST(COALESCE(max(CASE WHEN building - furniture > 0 THEN rank END), 0) + 1 AS BIGINT) AS crossover,
      round(avg(CASE WHEN rank <= 2 THEN building - furniture END), 2) AS top_premium FROM cv GROUP BY league_key""",
)
def report_crossover(t: Tables) -> DataFrame:
    """The first place from which the other position is worth more."""
    gap = F.col("building") - F.col("furniture")
    ahead = F.max(F.when(gap > 0, F.col("rank")))
    return scarcity(t).groupBy("league_key").agg(
        (F.coalesce(ahead, F.lit(0)) + 1).cast("long").alias("crossover"),
        F.round(F.avg(F.when(F.col("rank") <= 2, gap)), 2).alias("top_premium"),
    )


_ROUNDS = "CAST(ceil(price / 40.0) AS BIGINT)"
_BY = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


@query(
    "report_value_by_round",
    f"WITH {FULL_VALUE} SELECT league_key, {_ROUNDS} AS round, "
    + ", ".join(f"round(avg(CASE WHEN position = '{p}' THEN actual_value END), 2) AS {p.lower()}" for p in _BY)
    + ", count(*) AS picks FROM dv WHERE actual_value IS NOT NULL GROUP BY ALL",
)
def report_value_by_round(t: Tables) -> DataFrame:
    """What each round returned, by position."""
    df = surplus(t).where(F.col("actual_value").isNotNull())
    step = F.ceil(F.col("price") / STEP).cast("long").alias("round")
    return df.groupBy("league_key", step).agg(
        *[F.round(F.avg(F.when(F.col("position") == p, F.col("actual_value"))), 2).alias(p.lower()) for p in _BY],
        F.count(F.lit(1)).alias("picks"),
    )


@query(
    "report_hit_rate",
    f"WITH {_PRICED}, {ENT}, {POR}, {ASKING}, {CHART}, {BUCKETS} SELECT league_key, {_ROUNDS} AS round, "
    + ", ".join(
        f"round(100 * avg(CASE WHEN position = '{p}' THEN CAST(is_elite_finish AS INT) END), 6) AS hit_{p.lower()}, count(*) FILTER (WHERE position = '{p}') AS n_{p.lower()}"
        for p in _BY
    )
    + " FROM bb WHERE price IS NOT NULL GROUP BY ALL",
)
def report_hit_rate(t: Tables) -> DataFrame:
    """Share of elite finishes by round and position, with counts."""
    df = bucket_table(t).where(F.col("price").isNotNull())
    step = F.ceil(F.col("price") / STEP).cast("long").alias("round")
    made = []
    for p in _BY:
        here = F.col("position") == p
        made.append(F.round(100 * F.avg(F.when(here, F.col("is_elite_finish").cast("int"))), 6).alias(f"hit_{p.lower()}"))
        made.append(F.count_if(here).alias(f"n_{p.lower()}"))
    return df.groupBy("league_key", step).agg(*made)


@query(
    "report_trial_coverage",
    f"""WITH {_PRICED}, {ENT}, {ROSTERS}
    SELECT league_key, variant, count(*) AS drafts, count(DISTINCT strategy) AS strategies, count(DISTINCT season) AS seasons,
      min(season) AS first_season, max(season) AS last_season FROM res GROUP BY ALL""",
)
def report_trial_coverage(t: Tables) -> DataFrame:
    """How many trials stand behind the tables."""
    return results(t).groupBy("league_key", "variant").agg(
        F.count(F.lit(1)).alias("drafts"), F.countDistinct("strategy").alias("strategies"),
        F.countDistinct("season").alias("seasons"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
    )


@query(
    "report_strategy_ranking",
    f"""WITH {STRATEGY}, r AS (
      SELECT league_key, strategy, round(points_vs_field, 3) AS points_vs_field, round(100 * win_rate, 6) AS win_pct,
        row_number() OVER (PARTITION BY league_key ORDER BY round(points_vs_field, 3) DESC, strategy) AS place,
        count(*) OVER (PARTITION BY league_key) AS of FROM ds WHERE is_actual)
    SELECT * FROM r WHERE place <= 5 OR place > of - 3 OR strategy IN ('3B2F', '2B3F')""",
)
def report_strategy_ranking(t: Tables) -> DataFrame:
    """Best five, worst three and named openings in each league's real format."""
    from pyspark.sql.window import Window as W

    points = F.round("points_vs_field", 3)
    # one row per opening of a league
    every = W.partitionBy("league_key")
    df = summary(t).where("is_actual").select(
        "league_key", "strategy", points.alias("points_vs_field"), F.round(100 * F.col("win_rate"), 6).alias("win_pct")
    )
    df = df.withColumn(
        "place", F.row_number().over(every.orderBy(F.col("points_vs_field").desc(), "strategy")).cast("long")
    ).withColumn("of", F.count(F.lit(1)).over(every))
    named = F.col("strategy").isin("3B2F", "2B3F")
    return df.where((F.col("place") <= 5) | (F.col("place") > F.col("of") - 3) | named)


@query(
    "report_significant",
    f"""WITH {STRATEGY}
    SELECT league_key, variant, count(*) AS strategies, round(CAST(0.05 * count(*) AS DOUBLE), 1) AS by_chance, count(*) FILTER (WHERE abs(t_stat) > 2) AS beyond_two,
      count(*) FILTER (WHERE t_stat > 2) AS good, count(*) FILTER (WHERE t_stat < -2) AS bad FROM ds GROUP BY ALL""",
)
def report_significant(t: Tables) -> DataFrame:
    """How many openings clear |t| > 2, against chance."""
    return summary(t).groupBy("league_key", "variant").agg(
        F.count(F.lit(1)).alias("strategies"), F.round(0.05 * F.count(F.lit(1)), 1).alias("by_chance"),
        F.count_if(F.abs("t_stat") > 2).alias("beyond_two"), F.count_if(F.col("t_stat") > 2).alias("good"),
        F.count_if(F.col("t_stat") < -2).alias("bad"),
    )


_ORDERED = f"""oq AS (
    SELECT league_key, variant, season, region, draft_slot, string_agg(upper(substr(position, 1, 1)), '-' ORDER BY round) AS sequence
    FROM dealt WHERE round <= {OPENING} GROUP BY ALL),
  og AS (SELECT res.league_key, sequence, avg(points_vs_field) AS v FROM res JOIN oq USING (league_key, variant, season, region, draft_slot)
         WHERE is_actual GROUP BY ALL)"""


@query(
    "report_opening_order",
    f"""WITH {_PRICED}, {ENT}, {ROSTERS}, {_ORDERED}
    SELECT league_key, split_part(sequence, '-', 1) AS opens, count(*) AS sequences, round(avg(v), 2) AS mean_value, round(min(v), 2) AS worst, round(max(v), 2) AS best,
      CAST(sum(len(regexp_extract_all(sequence, 'B'))) AS BIGINT) AS b_picks
    FROM og GROUP BY ALL""",
)
def report_opening_order(t: Tables) -> DataFrame:
    """Pick sequences grouped by what they open with."""
    return order_values(t).groupBy("league_key", F.split("sequence", "-")[0].alias("opens")).agg(
        F.count(F.lit(1)).alias("sequences"), mean_of("v", 2, "mean_value"), F.round(F.min("v"), 2).alias("worst"),
        F.round(F.max("v"), 2).alias("best"),
        F.sum(F.regexp_count("sequence", F.lit("B"))).alias("b_picks"),
    )


def order_values(t: Tables) -> DataFrame:
    """Mean edge of every opening pick sequence, in each league's real format."""
    return opening_sequences(t).groupBy("league_key", "sequence").agg(F.avg("points_vs_field").alias("v"))


@query(
    "report_opening_claim",
    f"""WITH {_PRICED}, {ENT}, {ROSTERS}, {_ORDERED}
    SELECT league_key, round(avg(v) FILTER (WHERE starts_with(sequence, 'B')) - avg(v) FILTER (WHERE starts_with(sequence, 'F')), 2) AS first_edge,
      COALESCE(min(v) FILTER (WHERE starts_with(sequence, 'B')) > max(v) FILTER (WHERE starts_with(sequence, 'F-F')), false) AS always_beats,
      round(max(v) - min(v), 2) AS spread,
      round(max(v) FILTER (WHERE NOT regexp_matches(sequence, 'A.*A|H.*H')) - min(v) FILTER (WHERE NOT regexp_matches(sequence, 'A.*A|H.*H')), 2) AS sensible_spread
    FROM og GROUP BY league_key""",
)
def report_opening_claim(t: Tables) -> DataFrame:
    """Does one opener always beat the other, and how wide is the spread?"""
    v, seq = F.col("v"), F.col("sequence")
    b, f, ff = F.startswith(seq, F.lit("B")), F.startswith(seq, F.lit("F")), F.startswith(seq, F.lit("F-F"))
    plain = ~F.rlike(seq, F.lit("A.*A|H.*H"))
    return order_values(t).groupBy("league_key").agg(
        F.round(F.avg(F.when(b, v)) - F.avg(F.when(f, v)), 2).alias("first_edge"),
        F.coalesce(F.min(F.when(b, v)) > F.max(F.when(ff, v)), F.lit(False)).alias("always_beats"),
        F.round(F.max(v) - F.min(v), 2).alias("spread"),
        F.round(F.max(F.when(plain, v)) - F.min(F.when(plain, v)), 2).alias("sensible_spread"),
    )


#: The report's own cut: prices a draft of the reference league still reaches.
BOARD_DEPTH = 400


@query(
    "report_best_value",
    f"""WITH {FULL_VALUE}
    SELECT position, entity_id, round(price, 1) AS price, projected_surplus, projected_surplus_rank FROM dv
    WHERE league_key = '{REFERENCE}' AND season = (SELECT max(season) FROM dv) AND projected_surplus IS NOT NULL AND price <= {BOARD_DEPTH}
    QUALIFY row_number() OVER (PARTITION BY position ORDER BY projected_surplus DESC, entity_id) <= 8""",
)
def report_best_value(t: Tables) -> DataFrame:
    """Best eight per position on the live board."""
    df = surplus(t)
    newest = df.agg(F.max("season").alias("m")).scalar()
    live = df.where(
        (F.col("league_key") == REFERENCE) & (F.col("season") == newest) & F.col("projected_surplus").isNotNull()
    )
    # ranked among all of its season, whatever the price
    live = with_rank(live, ["league_key", "season"], "projected_surplus", descending=True, rank="projected_surplus_rank")
    live = live.where(F.col("price") <= BOARD_DEPTH)
    best = top_k(live, ["position"], [F.col("projected_surplus").desc(), F.col("entity_id")], 8)
    return best.select("position", "entity_id", F.round("price", 1).alias("price"), "projected_surplus", "projected_surplus_rank")


@query(
    "report_projection_spread",
    f"""WITH {O}, {ENT}, {BASELINE}, {PREDICTED}
    SELECT position, count(*) AS entities, max(predicted) AS best, round(quantile_cont(predicted, 0.5), 2) AS median FROM pq WHERE predicted > 0 GROUP BY position""",
)
def report_projection_spread(t: Tables) -> DataFrame:
    """Projections per position: count, best, median."""
    df = t.gold("predicted", lambda: predicted_rates(t)).where(F.col("predicted") > 0)
    flat = df.groupBy("position").agg(F.count(F.lit(1)).alias("entities"), F.max("predicted").alias("best"))
    median = group_percentiles(df, ["position"], "predicted", {"median": 0.5})
    return flat.join(median, "position").withColumn("median", F.round("median", 2))


@query(
    "report_settings_sheet",
    f"""WITH {O}, {ENT}, s AS (
      SELECT team, count(DISTINCT entity_id) AS entities, count(*) FILTER (WHERE source = '1-URGENT') AS urgent, count(*) FILTER (WHERE source = '5-LOW') AS low
      FROM o JOIN ent USING (entity_id) GROUP BY team)
    SELECT team, setting, CAST(value AS BIGINT) AS value, CASE WHEN low > urgent THEN 'superflex' ELSE '1qb' END AS format FROM (
      SELECT team, urgent, low, 'entities' AS setting, entities AS value FROM s UNION ALL SELECT team, urgent, low, 'urgent', urgent FROM s
      UNION ALL SELECT team, urgent, low, 'low', low FROM s)""",
)
def report_settings_sheet(t: Tables) -> DataFrame:
    """A settings sheet turned on its side, with the format it implies."""
    df = t.orders().join(t.entities(), "entity_id").groupBy("team").agg(
        F.countDistinct("entity_id").alias("entities"), F.count_if(F.col("source") == "1-URGENT").alias("urgent"),
        F.count_if(F.col("source") == "5-LOW").alias("low"),
    ).withColumn("format", F.when(F.col("low") > F.col("urgent"), "superflex").otherwise("1qb"))
    return df.unpivot(["team", "format"], ["entities", "urgent", "low"], "setting", "value")


@query(
    "report_by_incumbency",
    f"""WITH {SEASONS}, {FIT}, {PROJ}
    SELECT incumbency, count(*) AS entities, round(avg(projected_points), 6) AS mean_projection FROM pj WHERE target_season = {UPCOMING} GROUP BY incumbency""",
)
def report_by_incumbency(t: Tables) -> DataFrame:
    """Projections by how settled the job is."""
    seasons = seasons_table(t)
    df = projections(seasons).where(F.col("target_season") == upcoming(seasons))
    return df.groupBy("incumbency").agg(F.count(F.lit(1)).alias("entities"), mean_of("projected_points", 6, "mean_projection"))
