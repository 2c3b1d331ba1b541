"""Team environment: shipments out of and into a nation."""

from pyspark.sql import DataFrame, functions as F

from seasonlake.operators.environment import (
    inside_flag, per_play_points, play_cells, residual_flag, start_bin, team_environment, unpivot_sides,
)
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import ENT, L, O
from seasonlake.plans.registry import query

PRICES = {"in10": 2.0, "in20": 1.0, "touchback": -0.5, "returned": -1.0}


def plays(t: Tables) -> DataFrame:
    """One row per line: seller nation, buyer nation, spot, distance and outcome flags."""
    orders = t.orders().select("order_id", "entity_id").join(
        t.entities().select("entity_id", F.col("team").alias("opponent")), "entity_id"
    ).select("order_id", "opponent")
    nation = t.raw("nation").select("n_nationkey", F.col("n_name").alias("team"))
    seller = t.raw("supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("n_nationkey")
    ).join(nation, "n_nationkey").select("supplier_id", "team")
    lines = t.lines().select(
        "order_id", "supplier_id", "season", "week", "units", "discount_pct", "return_flag", "line_status"
    )
    lines = lines.join(orders, "order_id").join(seller, "supplier_id")
    gain = F.when(F.col("return_flag") == "R", 3)
    wide = F.when(F.col("units") % 7 != 0, F.col("units") > 45)
    return lines.select(
        "team", "opponent", "season", "week",
        F.col("units").alias("own_yard"),
        F.col("discount_pct").alias("distance"),
        inside_flag(F.col("discount_pct") <= 2, F.lit(50), F.col("units"), gain).alias("in10"),
        (F.col("discount_pct") <= 2).cast("int").alias("in20"),
        (F.col("return_flag") == "A").cast("int").alias("touchback"),
        residual_flag([F.col("return_flag") == "A", wide, F.col("discount_pct") == 0]).alias("returned"),
    )


def calendar(cells: DataFrame) -> DataFrame:
    """Meetings of two nations in a month, and the score of each."""
    games = cells.where(F.col("team") != F.col("opponent")).select(
        "season", "week", "team", "opponent", "own_yard", "distance"
    )
    return unpivot_sides(games, ["season"], "team", "opponent", "own_yard", "distance")


PLAYS = """sel AS (SELECT s_suppkey AS supplier_id, n_name AS team FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  pl AS (
    SELECT sel.team, ent.team AS opponent, l.season, l.week, units AS own_yard, discount_pct AS distance,
      CASE WHEN discount_pct <= 2 AND 50 - units + COALESCE(CASE WHEN return_flag = 'R' THEN 3 END, 0) < 10 THEN 1 ELSE 0 END AS in10,
      CAST(discount_pct <= 2 AS INT) AS in20, CAST(return_flag = 'A' AS INT) AS touchback,
      CASE WHEN return_flag = 'A' OR COALESCE(CASE WHEN units % 7 <> 0 THEN units > 45 END, false) OR discount_pct = 0
           THEN 0 ELSE 1 END AS returned
    FROM l JOIN o USING (order_id) JOIN ent ON ent.entity_id = o.entity_id JOIN sel ON sel.supplier_id = l.supplier_id)"""
_PP = "(1.0 + 2.0 * avg(in10) + 1.0 * avg(in20) + -0.5 * avg(touchback) + -1.0 * avg(returned))"
ENV = f"""{O}, {ENT}, {L}, {PLAYS},
  gm AS (SELECT season, week, team, opponent, sum(own_yard) AS home_score, sum(distance) AS away_score
         FROM pl WHERE team <> opponent GROUP BY ALL),
  sides AS (SELECT season, team, home_score AS points_for, away_score AS points_against FROM gm UNION ALL
            SELECT season, opponent, away_score, home_score FROM gm),
  cal AS (SELECT team, season, count(*) AS games, avg(points_for) AS points_for, avg(points_against) AS points_against FROM sides GROUP BY ALL),
  off AS (SELECT team, season, count(*) AS plays, avg(own_yard) AS avg_spot,
            avg(CASE WHEN own_yard > 40 THEN 1.0 ELSE 0.0 END) AS forward_share,
            avg(CASE WHEN own_yard <= 20 THEN 1.0 ELSE 0.0 END) AS deep_share, avg(distance) AS gross_average,
            avg(in10) AS in10_rate, avg(in20) AS in20_rate, avg(touchback) AS touchback_rate, avg(returned) AS returned_rate,
            {_PP} AS points_per_play FROM pl GROUP BY ALL),
  def AS (SELECT opponent AS team, season, count(*) AS forced, avg(own_yard) AS opp_avg_spot, {_PP} AS opp_points_per_play FROM pl GROUP BY ALL),
  env AS (
    SELECT team, season, games, points_for, points_against, plays, avg_spot, forward_share, deep_share, gross_average, in10_rate, in20_rate,
      touchback_rate, returned_rate, points_per_play, opp_avg_spot, opp_points_per_play,
      plays / games AS plays_per_game, plays / games * points_per_play AS play_points_per_game,
      forced / games AS forced_per_game, forced / games * opp_points_per_play AS points_allowed_per_game
    FROM off JOIN def USING (team, season) JOIN cal USING (team, season))"""


def environment(t: Tables) -> DataFrame:
    cells = t.gold("play_cells", lambda: play_cells(plays(t), ["team", "opponent", "season", "week"], PRICES))
    return team_environment(cells, calendar(cells), 1.0, PRICES)


@query(
    "field_environment",
    f"WITH {ENV} SELECT team, season, games, plays, "
    + ", ".join(
        f"round({c}, 8) AS {c}"
        for c in (
            "points_for", "points_against", "avg_spot", "forward_share", "deep_share", "gross_average",
            "in10_rate", "in20_rate", "touchback_rate", "returned_rate", "points_per_play", "opp_avg_spot",
            "opp_points_per_play", "plays_per_game", "play_points_per_game", "forced_per_game",
            "points_allowed_per_game",
        )
    )
    + " FROM env",
)
def field_environment(t: Tables) -> DataFrame:
    """What a nation ships and receives per season, per meeting and per shipment."""
    df = environment(t)
    return df.select(*[F.round(c, 8).alias(c) if kind == "double" else c for c, kind in df.dtypes])


EDGES = (10, 20, 30, 40)
LABELS = ("1-10", "11-20", "21-30", "31-40")


@query(
    "report_value_by_start",
    f"""WITH {O}, {ENT}, {L}, {PLAYS}
    SELECT CASE WHEN own_yard <= 10 THEN '1-10' WHEN own_yard <= 20 THEN '11-20' WHEN own_yard <= 30 THEN '21-30'
                WHEN own_yard <= 40 THEN '31-40' ELSE 'beyond' END AS start, min(own_yard) AS sort_key, count(*) AS plays,
           round(avg(distance), 8) AS gross, round(avg(in20), 8) AS in20_rate, round(avg(returned), 8) AS returned_rate,
           round({_PP}, 8) AS points_per_play
    FROM pl GROUP BY 1 ORDER BY sort_key""",
)
def report_value_by_start(t: Tables) -> DataFrame:
    """Value by binned start."""
    label = start_bin(F.col("own_yard"), EDGES, LABELS, "beyond")
    return plays(t).groupBy(label.alias("start")).agg(
        F.min("own_yard").alias("sort_key"), F.count(F.lit(1)).alias("plays"),
        F.round(F.avg("distance"), 8).alias("gross"), F.round(F.avg("in20"), 8).alias("in20_rate"),
        F.round(F.avg("returned"), 8).alias("returned_rate"),
        F.round(per_play_points(1.0, PRICES), 8).alias("points_per_play"),
    ).orderBy("sort_key")


@query(
    "report_volume_quintiles",
    f"""WITH {ENV}, q AS (SELECT *, ntile(5) OVER (ORDER BY round(plays_per_game, 8), season, team) AS bucket FROM env)
    SELECT CASE bucket WHEN 1 THEN '1 fewest' WHEN 5 THEN '5 most' ELSE CAST(bucket AS VARCHAR) END AS quintile,
      round(avg(plays_per_game), 4) AS plays_per_game, round(avg(avg_spot), 4) AS avg_spot,
      round(avg(points_per_play), 4) AS points_per_play, round(avg(play_points_per_game), 4) AS play_points_per_game,
      round(avg(points_for), 4) AS points_for FROM q GROUP BY bucket ORDER BY bucket""",
)
def report_volume_quintiles(t: Tables) -> DataFrame:
    """Quintiles of volume against value; the table holds team-seasons only."""
    from pyspark.sql.window import Window as W

    order = W.orderBy(F.round("plays_per_game", 8), "season", "team")
    df = environment(t).withColumn("bucket", F.ntile(5).over(order))
    label = F.when(F.col("bucket") == 1, "1 fewest").when(F.col("bucket") == 5, "5 most").otherwise(
        F.col("bucket").cast("string")
    )
    columns = ("plays_per_game", "avg_spot", "points_per_play", "play_points_per_game", "points_for")
    return df.groupBy("bucket").agg(*[F.round(F.avg(c), 4).alias(c) for c in columns]).orderBy(
        "bucket"
    ).select(label.alias("quintile"), *columns)


@query(
    "report_opponent_ranking",
    f"""WITH {ENV}, m AS (
      SELECT team, round(sum(forced_per_game * games) / sum(games), 6) AS forced_per_game,
             round(sum(points_allowed_per_game * games) / sum(games), 6) AS points_allowed_per_game FROM env GROUP BY team),
    r AS (SELECT *, row_number() OVER (ORDER BY points_allowed_per_game DESC, team) AS best,
             row_number() OVER (ORDER BY points_allowed_per_game, team DESC) AS worst,
             round(max(points_allowed_per_game) OVER () - min(points_allowed_per_game) OVER (), 6) AS spread FROM m)
    SELECT team, forced_per_game, points_allowed_per_game, best, spread FROM r WHERE best <= 5 OR worst <= 5""",
)
def report_opponent_ranking(t: Tables) -> DataFrame:
    """Games-weighted opponents, five most and five least generous, and the spread."""
    from pyspark.sql.window import Window as W

    games = F.col("games")
    means = environment(t).groupBy("team").agg(
        *[
            F.round(F.sum(F.col(c) * games) / F.sum(games), 6).alias(c)
            for c in ("forced_per_game", "points_allowed_per_game")
        ]
    )
    allowed = F.col("points_allowed_per_game")
    one_row_per_team = W.partitionBy(F.lit(1))
    out = means.withColumn(
        "best", F.row_number().over(one_row_per_team.orderBy(allowed.desc(), "team")).cast("long")
    ).withColumn(
        "_worst", F.row_number().over(one_row_per_team.orderBy(allowed.asc(), F.col("team").desc()))
    ).withColumn("spread", F.round(F.max(allowed).over(one_row_per_team) - F.min(allowed).over(one_row_per_team), 6))
    return out.where((F.col("best") <= 5) | (F.col("_worst") <= 5)).drop("_worst")
