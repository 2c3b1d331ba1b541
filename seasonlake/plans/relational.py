"""Joins, ranks, aggregates and set operations in their plain forms."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.operators.asof import depth_chart, forward_asof, latest_per_label
from seasonlake.operators.ranking import (
    group_percentiles, tile_of, top_k, with_position, with_rank,
)
from seasonlake.operators.settings import linear_points, with_settings
from seasonlake.plans.bindings import Tables, cents
from seasonlake.plans.leagues import LG, SETTINGS
from seasonlake.plans.oracle_parts import BASE, ENT, O, ST, TOT
from seasonlake.plans.registry import query


@query(
    "asof_snapshot",
    """WITH s AS (SELECT event_id, user_id, month(ts) AS season, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup'),
    p AS (SELECT DISTINCT user_id, month(ts) AS season, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
    m AS (SELECT s.*, (SELECT min(p.day) FROM p WHERE p.user_id = s.user_id AND p.season = s.season AND p.day >= s.day) AS target FROM s),
    k AS (SELECT * FROM m WHERE target IS NOT NULL QUALIFY day = max(day) OVER (PARTITION BY user_id, season, target))
    SELECT event_id, user_id, CAST(day AS VARCHAR) AS day, CAST(target AS VARCHAR) AS target FROM k""",
)
def asof_snapshot(t: Tables) -> DataFrame:
    """Each signup to the user's next purchase day; the last signup before it wins."""
    e = t.raw("events").select(
        "event_id", "user_id", F.month("ts").alias("season"), F.to_date("ts").alias("day"), "event_type"
    )
    signups = e.where(F.col("event_type") == "signup").drop("event_type")
    buys = e.where(F.col("event_type") == "purchase").select("user_id", "season", F.col("day").alias("at"), F.col("day").alias("target"))
    mapped = forward_asof(signups, buys, ["user_id", "season"], "day", "at", "target")
    kept = latest_per_label(mapped, ["user_id", "season"], "target", "day")
    return kept.select("event_id", "user_id", F.col("day").cast("string").alias("day"), F.col("target").cast("string").alias("target"))


@query(
    "asof_timestamps",
    """WITH e AS (SELECT event_id, month(ts) AS month, ts, event_type FROM events),
    s AS (SELECT event_id, month, ts FROM e WHERE event_type = 'signup'),
    p AS (SELECT month, ts AS at, min(event_id) AS purchase_id FROM e WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT s.event_id, s.month, purchase_id FROM s ASOF JOIN p ON s.month = p.month AND s.ts <= p.at""",
)
def asof_timestamps(t: Tables) -> DataFrame:
    """Each signup to the first purchase of its month, by the moment, in groups of a month's events."""
    e = t.raw("events").select("event_id", F.month("ts").alias("month"), "ts", "event_type")
    signups = e.where(F.col("event_type") == "signup").drop("event_type")
    buys = e.where(F.col("event_type") == "purchase").select("month", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    return forward_asof(signups, buys, ["month"], "ts", "at", "purchase_id").drop("ts")


STARTERS = {"AUTOMOBILE": 1, "BUILDING": 1, "FURNITURE": 3, "HOUSEHOLD": 1}
_SLOT = "CASE position " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in STARTERS.items()) + " END"
CHARTS = f"""x AS (SELECT o.*, team, position, CAST(substr(source, 1, 1) AS BIGINT) AS digit FROM o JOIN ent USING (entity_id)
      WHERE position IN {tuple(STARTERS)} AND status <> 'P'),
  old AS (SELECT season, week, team, entity_id, position, min(digit) AS string_team, CAST(NULL AS BIGINT) AS depth_rank FROM x WHERE season <= 1998 GROUP BY ALL),
  ws AS (SELECT season, week, min(day) AS first_game FROM o GROUP BY ALL),
  dd AS (SELECT DISTINCT season, day FROM x WHERE season > 1998),
  mw AS (SELECT dd.*, (SELECT min(week) FROM ws WHERE ws.season = dd.season AND ws.first_game >= dd.day) AS week FROM dd),
  lw AS (SELECT season, week, max(day) AS day FROM mw WHERE week IS NOT NULL GROUP BY ALL),
  new AS (SELECT x.season, lw.week, team, entity_id, position, CAST(NULL AS BIGINT) AS string_team, min(digit) AS depth_rank
          FROM x JOIN lw ON lw.season = x.season AND lw.day = x.day GROUP BY ALL),
  chart AS (SELECT *, COALESCE(string_team = 1, depth_rank <= {_SLOT}) AS is_starter FROM (SELECT * FROM old UNION ALL SELECT * FROM new))"""


@query("starter_flag", f"WITH {O}, {ENT}, {CHARTS} SELECT * FROM chart")
def starter_flag(t: Tables) -> DataFrame:
    """One starter call over a weekly era and a dated-snapshot era."""
    o = t.orders()
    rows = o.where(F.col("status") != "P").join(t.entities(), "entity_id").where(
        F.col("position").isin(*STARTERS)
    ).withColumn("digit", F.substring("source", 1, 1).cast("long"))
    coarse = rows.where(F.col("season") <= 1998).withColumnRenamed("digit", "string_team")
    fine = rows.where(F.col("season") > 1998).select(
        "season", "day", "team", "entity_id", "position", F.col("digit").alias("depth_rank")
    )
    weeks = o.groupBy("season", "week").agg(F.min("day").alias("first_game"))
    return depth_chart(coarse, fine, weeks, STARTERS)


@query(
    "rank_suite",
    f"""{BASE}
    SELECT entity_id, season, position, points_c, games,
      rank() OVER w AS points_rank, round(percent_rank() OVER (PARTITION BY season, position ORDER BY points_c), 8) AS points_percentile,
      row_number() OVER (PARTITION BY season, position ORDER BY games DESC, entity_id) AS position_rank,
      ntile(5) OVER (PARTITION BY season, position ORDER BY games DESC, entity_id) AS quintile,
      count(*) OVER (PARTITION BY season, position) AS field,
      rank() OVER (PARTITION BY season, position ORDER BY games) + (count(*) OVER (PARTITION BY season, position, games) - 1) / 2.0 AS games_average_rank
    FROM st WINDOW w AS (PARTITION BY season, position ORDER BY points_c DESC)""",
)
def rank_suite(t: Tables) -> DataFrame:
    """Rank, percentile, position, quintile and average rank in large groups."""
    keys = ["season", "position"]
    df = t.season_totals().select("entity_id", "season", "position", "points_c", "games")
    base = df
    # one count of the values serves the rank from the top and the percentile from below
    df = with_rank(
        df, keys, "points_c", descending=True, rank="points_rank", percent_rank_desc="points_percentile"
    )
    df = with_position(df, keys, "games", "entity_id", total="field")
    df = with_rank(df, keys, "games", source=base, average_rank="games_average_rank")
    return df.withColumn("quintile", tile_of(F.col("position_rank"), F.col("field"), 5)).withColumn(
        "points_percentile", F.round("points_percentile", 8)
    )


@query(
    "top_per_group",
    f"""{BASE} SELECT season, position, entity_id, points_c FROM st
    QUALIFY row_number() OVER (PARTITION BY season, position ORDER BY points_c DESC, entity_id) <= 8""",
)
def top_per_group(t: Tables) -> DataFrame:
    """R22's shape: best eight per season and position."""
    df = t.season_totals().select("season", "position", "entity_id", "points_c")
    return top_k(df, ["season", "position"], [F.col("points_c").desc(), F.col("entity_id")], 8).drop("_rn")


@query(
    "head_tail",
    f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY points_c DESC, entity_id) AS a,
      row_number() OVER (PARTITION BY season, position ORDER BY points_c, entity_id DESC) AS b FROM st)
    SELECT season, position, entity_id, points_c FROM r WHERE a <= 5 OR b <= 3 OR entity_id = 10""",
)
def head_tail(t: Tables) -> DataFrame:
    """Best five, worst three and named rows of every group, each once."""
    df = t.season_totals().select("season", "position", "entity_id", "points_c")
    keys = ["season", "position"]
    best = top_k(df, keys, [F.col("points_c").desc(), F.col("entity_id")], 5)
    worst = top_k(df, keys, [F.col("points_c").asc(), F.col("entity_id").desc()], 3)
    named = df.where(F.col("entity_id") == 10)
    return best.drop("_rn").unionByName(worst.drop("_rn")).unionByName(named).distinct()


@query(
    "pooled_top_k",
    f"""{BASE}, a AS (SELECT entity_id, season, points_c FROM st ORDER BY points_c DESC, entity_id LIMIT 25),
    b AS (SELECT entity_id, season, points_c FROM st ORDER BY points_c, entity_id LIMIT 10)
    SELECT 'largest' AS side, * FROM a UNION ALL SELECT 'smallest', * FROM b""",
)
def pooled_top_k(t: Tables) -> DataFrame:
    """Largest 25 and smallest 10 of the whole pool."""
    df = t.season_totals().select("entity_id", "season", "points_c")
    high = df.orderBy(F.col("points_c").desc(), "entity_id").limit(25)
    low = df.orderBy(F.col("points_c").asc(), "entity_id").limit(10)
    return high.select(F.lit("largest").alias("side"), "*").unionByName(low.select(F.lit("smallest").alias("side"), "*"))


@query(
    "group_percentiles",
    f"""{BASE} SELECT season, position, round(quantile_cont(points_c, 0.2), 4) AS p20, round(quantile_cont(points_c, 0.5), 4) AS p50,
      round(quantile_cont(points_c, 0.8), 4) AS p80 FROM st GROUP BY ALL""",
)
def group_percentiles_query(t: Tables) -> DataFrame:
    """Exact percentiles of groups too large for one task."""
    df = group_percentiles(t.season_totals(), ["season", "position"], "points_c", {"p20": 0.2, "p50": 0.5, "p80": 0.8})
    return df.select("season", "position", *[F.round(p, 4).alias(p) for p in ("p20", "p50", "p80")])


@query(
    "agg_basics",
    f"""WITH {O}, {ENT}, x AS (SELECT o.*, position FROM o JOIN ent USING (entity_id))
    SELECT season, position, count(*) AS n, CAST(sum(points_c) AS BIGINT) AS points_c, min(points_c) AS low, max(points_c) AS high,
      min(nullif(status, 'F')) AS first_other, arg_max(source, order_id) AS last_source, arg_min(source, order_id) AS first_source,
      count(DISTINCT entity_id) AS entities, count(*) FILTER (WHERE status = 'F') AS n_f,
      round(avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END), 8) AS f_share,
      round(sum(points_c * week) * 1.0 / sum(week), 6) AS weighted_mean, max(points_c) - min(points_c) AS spread
    FROM x GROUP BY season, position HAVING count(*) >= 6""",
)
def agg_basics(t: Tables) -> DataFrame:
    """Counts, bounds, first and last values, distinct entities, shares, a sample gate."""
    x = t.orders().join(t.entities().select("entity_id", "position"), "entity_id")
    points, f = F.col("points_c"), F.col("status") == "F"
    return x.groupBy("season", "position").agg(
        F.count(F.lit(1)).alias("n"), F.sum(points).alias("points_c"), F.min(points).alias("low"), F.max(points).alias("high"),
        F.min(F.nullif("status", F.lit("F"))).alias("first_other"),
        F.max_by("source", "order_id").alias("last_source"), F.min_by("source", "order_id").alias("first_source"),
        F.countDistinct("entity_id").alias("entities"), F.count_if(f).alias("n_f"),
        F.round(F.avg(F.when(f, 1.0).otherwise(0.0)), 8).alias("f_share"),
        F.round(F.sum(points * F.col("week")) / F.sum("week"), 6).alias("weighted_mean"),
        (F.max(points) - F.min(points)).alias("spread"),
    ).where(F.col("n") >= 6)


@query(
    "distinct_rows",
    f"""WITH {O}, {ENT} SELECT season, week, team, position, count(DISTINCT entity_id) AS entities FROM (
      SELECT DISTINCT season, week, entity_id FROM o) JOIN ent USING (entity_id) GROUP BY ALL""",
)
def distinct_rows(t: Tables) -> DataFrame:
    """Duplicates removed on a key subset before anything is joined."""
    rows = t.orders().select("season", "week", "entity_id").dropDuplicates(["season", "week", "entity_id"])
    return rows.join(t.entities(), "entity_id").groupBy("season", "week", "team", "position").agg(
        F.countDistinct("entity_id").alias("entities")
    )


@query(
    "top_value_column",
    f"""{BASE} SELECT season, team, position,
      max(CASE WHEN games >= 2 THEN points_c END) AS best_regular, max(points_c) FILTER (WHERE games = 1) AS best_single
    FROM st GROUP BY GROUPING SETS ((season, team, position))""",
)
def top_value_column(t: Tables) -> DataFrame:
    """Conditional pivot columns."""
    points = F.col("points_c")
    return t.season_totals().groupBy("season", "team", "position").agg(
        F.max(F.when(F.col("games") >= 2, points)).alias("best_regular"),
        F.max(F.when(F.col("games") == 1, points)).alias("best_single"),
    )


@query(
    "semi_anti",
    f"""WITH {O}, {ENT},
    a AS (SELECT entity_id, 'active' AS cohort FROM ent WHERE EXISTS (SELECT 1 FROM o WHERE o.entity_id = ent.entity_id AND season = 2000)),
    b AS (SELECT ent.entity_id, 'absent' FROM ent LEFT JOIN (SELECT DISTINCT entity_id FROM o WHERE season = 2000) k USING (entity_id) WHERE k.entity_id IS NULL)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def semi_anti(t: Tables) -> DataFrame:
    """Semi and anti joins against a key set."""
    keys = t.orders(first=2000, last=2000).select("entity_id").distinct()
    people = t.entities().select("entity_id")
    active = people.join(keys, "entity_id", "left_semi").withColumn("cohort", F.lit("active"))
    absent = people.join(keys, "entity_id", "left_anti").withColumn("cohort", F.lit("absent"))
    return active.unionByName(absent)


@query(
    "settings_table",
    f"""{BASE}, pool AS (SELECT season, position, sum(games) AS games, sum(points_c) AS points_c FROM st GROUP BY ALL)
    SELECT p_partkey AS league_key, season, position,
      CAST(games * p_size + points_c * CAST(round(p_retailprice * 100) AS BIGINT) AS BIGINT) AS league_points
    FROM pool CROSS JOIN part""",
)
def settings_table(t: Tables) -> DataFrame:
    """Position totals priced by a whole table of settings, one row of it per part."""
    pool = t.season_totals().groupBy("season", "position").agg(F.sum("games").alias("games"), F.sum("points_c").alias("points_c"))
    prices = t.raw("part").select(
        F.col("p_partkey").alias("league_key"), F.col("p_size").cast("long").alias("game_price"), cents("p_retailprice").alias("point_price")
    )
    priced = with_settings(pool, prices, ["league_key", "game_price", "point_price"])
    return priced.select(
        "league_key", "season", "position", linear_points({"games": "game_price", "points_c": "point_price"}).cast("long").alias("league_points")
    )


@query(
    "feature_star",
    f"""WITH {O}, {ENT}, {TOT},
    tm AS (SELECT team, season, sum(points_c) AS team_c FROM tot JOIN ent USING (entity_id) GROUP BY ALL),
    fst AS (SELECT entity_id, min(season) AS rookie FROM tot GROUP BY ALL)
    SELECT t.entity_id, t.season, t.season - rookie AS experience, p.points_c AS points_prior, CAST(tm.team_c AS BIGINT) AS team_prior,
      COALESCE(w.n, 0) AS early_orders, CASE WHEN p.points_c IS NOT NULL THEN CAST(p.points_c > t.points_c AS BIGINT) END AS declined
    FROM tot t JOIN ent ON ent.entity_id = t.entity_id LEFT JOIN fst ON fst.entity_id = t.entity_id
    LEFT JOIN tot p ON p.entity_id = t.entity_id AND p.season = t.season - 1
    LEFT JOIN tm ON tm.team = ent.team AND tm.season = t.season - 1
    LEFT JOIN (SELECT entity_id, season, count(*) AS n FROM o WHERE week <= 3 GROUP BY ALL) w ON w.entity_id = t.entity_id AND w.season = t.season""",
)
def feature_star(t: Tables) -> DataFrame:
    """Left-join star with lagged keys; unknown stays NULL, absent counts are 0."""
    totals = t.totals()
    people = t.entities().select("entity_id", "team")
    spine = totals.join(people, "entity_id")
    team = spine.groupBy("team", (F.col("season") + 1).alias("season")).agg(F.sum("points_c").alias("team_prior"))
    first = totals.groupBy("entity_id").agg(F.min("season").alias("rookie"))
    prior = totals.select("entity_id", (F.col("season") + 1).alias("season"), F.col("points_c").alias("points_prior"))
    early = t.orders().where(F.col("week") <= 3).groupBy("entity_id", "season").agg(F.count(F.lit(1)).alias("early"))
    df = spine.join(first, "entity_id", "left").join(prior, ["entity_id", "season"], "left")
    df = df.join(team, ["team", "season"], "left").join(early, ["entity_id", "season"], "left")
    moved = (F.col("points_prior") > F.col("points_c")).cast("long")
    return df.select(
        "entity_id", "season", (F.col("season") - F.col("rookie")).alias("experience"), "points_prior", "team_prior",
        F.coalesce("early", F.lit(0)).alias("early_orders"), moved.alias("declined"),
    )


@query(
    "settings_board",
    f"""WITH {O}, {ENT}, {TOT}, {ST}, {LG} SELECT league_key, team_count, entity_id, season, points_c FROM st CROSS JOIN lg""",
)
def settings_board(t: Tables) -> DataFrame:
    """Every row under every settings row, without a join."""
    return with_settings(t.season_totals(), SETTINGS, ["league_key", "team_count"]).select(
        "league_key", "team_count", "entity_id", "season", "points_c"
    )


@query(
    "ragged_union",
    f"""{BASE}
    SELECT season, entity_id AS key, points_c, NULL AS team, NULL AS teams FROM st WHERE games >= 5
    UNION ALL SELECT season, NULL, CAST(sum(points_c) AS BIGINT), team, NULL FROM st GROUP BY season, team
    UNION ALL SELECT season, NULL, NULL, NULL, count(DISTINCT team) FROM st GROUP BY season""",
)
def ragged_union(t: Tables) -> DataFrame:
    """Arms with different columns in one table."""
    st = t.season_totals()
    a = st.where(F.col("games") >= 5).select("season", F.col("entity_id").alias("key"), "points_c")
    b = st.groupBy("season", "team").agg(F.sum("points_c").alias("points_c"))
    c = st.groupBy("season").agg(F.countDistinct("team").alias("teams"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query(
    "group_center",
    f"""{BASE}, c AS (SELECT season, team, CAST(sum(points_c) AS BIGINT) AS v FROM st GROUP BY ALL)
    SELECT season, team, v, round(v - avg(v) OVER (PARTITION BY season), 4) AS centered, max(v) OVER w - min(v) OVER w AS spread,
      round((sum(v) OVER w - v) / (count(*) OVER w - 1), 4) AS others_mean, rank() OVER (PARTITION BY season ORDER BY v DESC) AS finish
    FROM c WINDOW w AS (PARTITION BY season)""",
)
def group_center(t: Tables) -> DataFrame:
    """Centred value, spread, mean of the others and finish; groups are teams of a season."""
    from pyspark.sql.window import Window as W

    every = W.partitionBy("season")
    v = F.col("v")
    sums = t.season_totals().groupBy("season", "team").agg(F.sum("points_c").alias("v"))
    return sums.select(
        "season", "team", "v", F.round(v - F.avg(v).over(every), 4).alias("centered"),
        (F.max(v).over(every) - F.min(v).over(every)).alias("spread"),
        F.round((F.sum(v).over(every) - v) / (F.count(v).over(every) - 1), 4).alias("others_mean"),
        F.rank().over(every.orderBy(v.desc())).cast("long").alias("finish"),
    )
