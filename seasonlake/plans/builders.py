"""The warehouse builders over feeds of their own shape, made from the driver tables.

player = customer, position = market segment, team = a spelling of a team by nation,
feed = order priority. The DuckDB texts start from the orders, not from the feeds.
"""

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake import warehouse
from seasonlake.functions.text import name_key
from seasonlake.plans.bindings import Tables
from seasonlake.plans.oracle_parts import O
from seasonlake.plans.registry import query

SEGMENT_POSITION = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE", "MACHINERY": "PK"}
#: Spellings of a team by nation key modulo 8, and the code each stands for.
SPELLINGS = [
    ("Kansas City Chiefs", "KC"), ("BUF", "BUF"), ("Las Vegas Raiders", "LV"), ("lac", "LAC"), ("Rams", "LA"), (" GB ", "GB"),
    ("Jets D/ST", "NYJ"), ("2TM", "2TM"),
]


def _choice(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def players(t: Tables) -> DataFrame:
    """entity_id, player_id, name, position and team as the feeds spell them."""
    return t.raw("customer").select(
        F.col("c_custkey").alias("entity_id"), F.format_string("00-%07d", "c_custkey").alias("player_id"),
        F.col("c_name").alias("name"), _choice(F.col("c_mktsegment"), SEGMENT_POSITION).alias("position"),
        _choice((F.col("c_nationkey") % 8).cast("int"), {i: s for i, (s, _) in enumerate(SPELLINGS)}).alias("team"),
    )


_POSITION = " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in SEGMENT_POSITION.items())
_CODE = " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(SPELLINGS))
PLAYERS = f"""{O}, pl AS (
  SELECT c_custkey AS entity_id, printf('00-%07d', c_custkey) AS player_id, c_name AS name,
    CASE c_mktsegment {_POSITION} END AS position, CASE c_nationkey % 8 {_CODE} END AS team FROM customer),
  po AS (SELECT o.*, player_id, name, position, team FROM o JOIN pl USING (entity_id))"""


def ids(t: Tables) -> DataFrame:
    key = F.col("entity_id")
    return players(t).select(
        F.col("player_id").alias("gsis_id"), "name", "position", key.cast("double").alias("espn_id"),
        (key + 100000).cast("double").alias("sleeper_id"), (key + 200000).cast("double").alias("cbs_id"),
        name_key(F.col("name")).alias("merge_name"),
    )


def played(t: Tables) -> DataFrame:
    return t.orders().join(players(t), "entity_id")


@query(
    "builder_line_grades",
    f"""WITH {PLAYERS},
    e AS (SELECT season, team, entity_id, position, count(*) AS games, count(*) FILTER (WHERE source = '1-URGENT') AS urgent, sum(points_c) AS points_c
          FROM po WHERE team <> '2TM' GROUP BY ALL),
    a AS (SELECT season, team, sum(urgent) * 1.0 / sum(games) AS pressure_rate_allowed FROM e GROUP BY ALL),
    b AS (SELECT season, team, sum(points_c) * 1.0 / sum(games) AS run_block_ybc_per_att FROM e WHERE position = 'RB' GROUP BY ALL),
    g AS (SELECT COALESCE(a.season, b.season) AS season, COALESCE(a.team, b.team) AS team, pressure_rate_allowed, run_block_ybc_per_att
          FROM a FULL JOIN b ON a.season = b.season AND a.team = b.team),
    r AS (SELECT *, 100 * (1 - percent_rank() OVER (PARTITION BY season ORDER BY pressure_rate_allowed NULLS LAST)) AS x,
            100 * percent_rank() OVER (PARTITION BY season ORDER BY run_block_ybc_per_att NULLS LAST) AS y FROM g)
    SELECT season, team, round(pressure_rate_allowed, 8) AS pressure_rate_allowed, round(run_block_ybc_per_att, 4) AS run_block_ybc_per_att,
      round(x, 6) AS pass_block_grade, round(y, 6) AS run_block_grade, round((x + y) / 2, 6) AS ol_grade FROM r""",
)
def builder_line_grades(t: Tables) -> DataFrame:
    """G04 from its two feeds: rows of several teams left out, spellings folded."""
    per = played(t).groupBy("season", "team", "entity_id", "position").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("source") == "1-URGENT").alias("urgent"), F.sum("points_c").alias("points_c")
    )
    passing = per.select("season", "team", F.col("games").alias("pass_attempts"), F.col("urgent").alias("times_pressured"))
    rushing = per.select("season", F.col("team").alias("tm"), F.col("position").alias("pos"), F.col("games").alias("att"), F.col("points_c").alias("ybc"))
    out = warehouse.line_grades(passing, rushing)
    digits = {"pressure_rate_allowed": 8, "run_block_ybc_per_att": 4, "pass_block_grade": 6, "run_block_grade": 6, "ol_grade": 6}
    return out.select("season", "team", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "builder_depth_chart",
    f"""WITH {PLAYERS},
    sk AS (SELECT *, CAST(substr(source, 1, 1) AS BIGINT) AS digit FROM po WHERE position <> 'PK' AND status <> 'P'),
    old AS (SELECT season, week, team, player_id AS gsis_id, position, min(digit) AS string_team, CAST(NULL AS BIGINT) AS depth_rank
            FROM sk WHERE season <= 1995 GROUP BY ALL),
    ws AS (SELECT season, week, min(day) AS first_game FROM o GROUP BY ALL),
    fi AS (SELECT season, day, order_id % 3 AS hour, team, player_id AS gsis_id, position, digit FROM sk WHERE season > 1995),
    la AS (SELECT season, day, max(hour) AS hour FROM fi GROUP BY ALL),
    f2 AS (SELECT fi.* FROM fi JOIN la USING (season, day, hour)),
    dd AS (SELECT DISTINCT season, day FROM f2),
    mw AS (SELECT dd.*, (SELECT min(week) FROM ws WHERE ws.season = dd.season AND ws.first_game >= dd.day) AS week FROM dd),
    lw AS (SELECT season, week, max(day) AS day FROM mw WHERE week IS NOT NULL GROUP BY ALL),
    new AS (SELECT f2.season, lw.week, team, gsis_id, position, CAST(NULL AS BIGINT) AS string_team, min(digit) AS depth_rank
            FROM f2 JOIN lw ON lw.season = f2.season AND lw.day = f2.day GROUP BY ALL)
    SELECT *, COALESCE(string_team = 1, depth_rank <= CASE position WHEN 'WR' THEN 3 ELSE 1 END) AS is_starter
    FROM (SELECT * FROM old UNION ALL SELECT * FROM new)""",
)
def builder_depth_chart(t: Tables) -> DataFrame:
    """G07 from weekly charts, stamped snapshots and the schedule, with rows it must leave out."""
    rows = played(t).where(F.col("status") != "P").withColumn("digit", F.substring("source", 1, 1))
    charts = rows.where(F.col("season") <= 1995).select(
        F.lit("Offense").alias("formation"), "position", F.col("position").alias("depth_position"), F.col("player_id").alias("gsis_id"),
        F.col("digit").alias("depth_team"), F.col("season").cast("string"), F.col("week").cast("string"), F.col("team").alias("club_code"),
    )
    defence = charts.withColumn("formation", F.lit("Defense"))
    nameless = charts.withColumn("gsis_id", F.lit(None).cast("string"))
    stamp = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T0"), (F.col("order_id") % 3).cast("string"), F.lit(":00:00Z"))
    snapshots = rows.where(F.col("season") > 1995).select(
        F.lit("3WR 1TE").alias("pos_grp"), F.col("position").alias("pos_abb"), F.col("player_id").alias("gsis_id"), "season", stamp.alias("dt"),
        "team", F.col("digit").alias("pos_rank"),
    )
    special = snapshots.withColumn("pos_grp", F.lit("Special Teams"))
    games = t.orders().select("season", "week", F.lit("REG").alias("game_type"), F.date_format("day", "yyyy-MM-dd").alias("gameday"))
    early = games.withColumn("game_type", F.lit("PRE")).withColumn("gameday", F.lit("1990-01-01"))
    # a feed's own order of kickers: they are no skill position
    skill = F.col("pos_abb") != "PK"
    return warehouse.depth_chart(
        charts.unionByName(defence).unionByName(nameless), snapshots.where(skill).unionByName(special), games.unionByName(early)
    )


@query(
    "builder_adp_consensus",
    f"""WITH {PLAYERS},
    sk AS (SELECT * FROM po WHERE position <> 'PK'),
    a AS (SELECT player_id, position, season, min(points_c) / 100 AS ranked_adp FROM sk WHERE source = '1-URGENT' GROUP BY ALL),
    b AS (SELECT player_id, position, season, max(points_c / 100) FILTER (WHERE source = '2-HIGH') AS mock_adp_standard,
            max(points_c / 100) FILTER (WHERE source = '3-MEDIUM') AS mock_adp_half_ppr, max(points_c / 100) FILTER (WHERE source = '5-LOW') AS mock_adp_ppr
          FROM sk WHERE source IN ('2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY ALL)
    SELECT COALESCE(a.player_id, b.player_id) AS gsis_id, COALESCE(a.position, b.position) AS position, COALESCE(a.season, b.season) AS season,
      ranked_adp, mock_adp_standard, mock_adp_half_ppr, mock_adp_ppr,
      COALESCE((ranked_adp + mock_adp_ppr) / 2, ranked_adp, mock_adp_ppr) AS consensus_adp,
      CAST((ranked_adp IS NOT NULL)::INT + (mock_adp_ppr IS NOT NULL)::INT AS INT) AS num_sources
    FROM a FULL JOIN b ON a.player_id = b.player_id AND a.season = b.season AND a.position = b.position""",
)
def builder_adp_consensus(t: Tables) -> DataFrame:
    """G03 from a ranked list and mock drafts of three formats, joined by name and position."""
    rows = played(t).select("name", "position", "season", (F.col("points_c") / 100).alias("adp"), "source")
    shouted = F.concat(F.lit("  "), F.upper("name"), F.lit(" Jr."))
    ranked = rows.where(F.col("source") == "1-URGENT").withColumn("name", shouted)
    formats = {"2-HIGH": "standard", "3-MEDIUM": "half-ppr", "5-LOW": "ppr"}
    mocked = rows.withColumn("scoring_format", _choice(F.col("source"), formats)).where(F.col("scoring_format").isNotNull())
    return warehouse.adp_consensus(ranked, mocked, ids(t))


_STATS = """count(*) AS num_sources, min(v) AS min_points, max(v) AS max_points, round(quantile_cont(v, 0.2), 4) AS floor_p20,
      round(quantile_cont(v, 0.5), 4) AS median_p50, round(quantile_cont(v, 0.8), 4) AS ceiling_p80, round(stddev_samp(v), 4) AS stddev_points"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("floor_p20", "median_p50", "ceiling_p80", "stddev_points")})


@query(
    "builder_consensus",
    f"""WITH {PLAYERS},
    n AS (SELECT *, CAST(points_c AS DOUBLE) AS v, CASE position WHEN 'PK' THEN 'K' ELSE position END AS pos FROM po),
    f AS (SELECT * FROM n WHERE season = 1997),
    arms AS (
      SELECT player_id, name, pos, 'espn' AS s, sum(v) AS v FROM f WHERE source = '1-URGENT' GROUP BY ALL
      UNION ALL SELECT player_id, name, pos, 'sleeper', max(v) FROM f WHERE source = '2-HIGH' GROUP BY ALL
      UNION ALL SELECT player_id, name, pos, 'fftoday', max(v) FROM f WHERE source = '3-MEDIUM' AND week % 2 = 1 GROUP BY ALL
      UNION ALL SELECT player_id, name, pos, 'inhouse', sum(v) FROM f GROUP BY ALL)
    SELECT player_id AS gsis_id, min(name) AS player_name, min(pos) AS position, {_STATS},
      max(v) FILTER (WHERE s = 'espn') AS espn_points, max(v) FILTER (WHERE s = 'sleeper') AS sleeper_points,
      max(v) FILTER (WHERE s = 'fftoday') AS fftoday_points, max(v) FILTER (WHERE s = 'inhouse') AS inhouse_points
    FROM arms GROUP BY player_id""",
)
def builder_consensus(t: Tables) -> DataFrame:
    """G01 from a weekly feed, a season feed, a feed of several scorings and the own arm."""
    kicker = F.when(F.col("position") == "PK", "K").otherwise(F.col("position"))
    rows = played(t).withColumn("position", kicker).withColumn("projected_points", F.col("points_c").cast("double"))
    feed = rows.where(F.col("season") == 1997)
    key = F.col("entity_id")
    feeds = {
        "espn": feed.where(F.col("source") == "1-URGENT").select(
            key.cast("string").alias("espn_id"), "season", "week", "position", "projected_points"),
        "sleeper": feed.where(F.col("source") == "2-HIGH").select(
            (key + 100000).cast("string").alias("sleeper_id"), F.col("season").cast("string").alias("season"), "position", "projected_points"),
        "fftoday": feed.where(F.col("source") == "3-MEDIUM").select(
            name_key(F.col("name")).alias("merge_name"), "season", F.when(F.col("week") % 2 == 1, "ppr").otherwise("half").alias("scoring"),
            "position", "projected_points"),
    }
    own = rows.groupBy("player_id", F.col("season").alias("target_season"), "position").agg(
        F.sum("projected_points").alias("projected_points_full"), F.min("name").alias("player_name")
    )
    return _rounded(warehouse.consensus_projections(feeds, ids(t), own))


@query(
    "builder_team_consensus",
    f"""WITH {PLAYERS},
    arms AS (SELECT team, source, CAST(sum(points_c) AS DOUBLE) AS v FROM po WHERE source <> '5-LOW' AND position IN ('RB', 'WR') GROUP BY ALL)
    SELECT team, {_STATS}, {', '.join(f"max(v) FILTER (WHERE source = '{s}') AS {n}_points" for n, s in
      (('one', '1-URGENT'), ('two', '2-HIGH'), ('three', '3-MEDIUM'), ('four', '4-NOT SPECIFIED')))}
    FROM arms GROUP BY team""",
)
def builder_team_consensus(t: Tables) -> DataFrame:
    """Team units under every spelling of the team, other positions left out."""
    unit = _choice(F.col("position"), {"QB": "QB", "RB": "DST", "WR": "DEF", "TE": "TE", "PK": "K"})
    rows = played(t).select("source", "team", unit.alias("position"), F.col("points_c").cast("double").alias("projected_points"))
    names = {"one": "1-URGENT", "two": "2-HIGH", "three": "3-MEDIUM", "four": "4-NOT SPECIFIED"}
    return _rounded(warehouse.team_consensus({n: rows.where(F.col("source") == s).drop("source") for n, s in names.items()}))
