"""All derived tables over a small made-up league, built in order."""

import random

import pytest
from pyspark.sql import functions as F

from seasonlake import warehouse
from seasonlake.functions import fixed_values as fixed

SEASONS = range(2015, 2024)
TEAMS = ["KC", "LA", "BUF", "OAK", "GB", "NYJ"]
STATS = [
    "targets", "receptions", "receiving_yards", "receiving_tds", "carries", "rushing_yards", "rushing_tds", "attempts",
    "passing_yards", "passing_tds", "passing_interceptions", "target_share", "air_yards_share", "wopr", "passing_epa",
    "rushing_epa", "receiving_epa", "passing_cpoe", "passing_2pt_conversions", "rushing_2pt_conversions",
    "receiving_2pt_conversions", *fixed.FUMBLE_COLUMNS,
]
PUNTS = ["pt_att", "pt_yards", "pt_inside_20", "pt_blocked", "pt_returned", "pt_touchback", "pt_fair_caught", "pt_net_yards"]


def league(key, teams, superflex):
    row = {"league_key": key, "team_count": teams, "qb_slots": 1, "rb_slots": 1, "wr_slots": 2, "te_slots": 1,
           "flex_slots": 1, "superflex_slots": superflex, "bench_slots": 4, "fum_lost_pts": -2.0}
    row |= {c: 0.1 for c in fixed.STAT_COEFFICIENTS.values()}
    row |= {c: 0.5 for c in fixed.PUNT_STAT_IDS}
    return row


@pytest.fixture(scope="module")
def silver(spark):
    rng = random.Random(1)
    players = [(f"00-{i:07d}", f"Player {i}", ["QB", "RB", "WR", "TE"][i % 4], rng.choice(TEAMS), rng.randrange(2012, 2023)) for i in range(96)]
    weekly, rosters, charts, snaps = [], [], [], []
    for pid, name, pos, team, rookie in players:
        for season in SEASONS:
            if season < rookie:
                continue
            skill = rng.uniform(2, 20)
            games = rng.randrange(0, 10)
            for week in range(1, games + 1):
                stats = {c: float(rng.randrange(0, 9)) for c in STATS} | {"fantasy_points_ppr": skill + rng.uniform(-2, 2)}
                for c in ("receiving_yards", "rushing_yards", "passing_yards"):
                    stats[c] = float(rng.randrange(0, 120))
                if pos == "TE":
                    stats["passing_epa"] = None
                weekly.append({"player_id": pid, "player_display_name": name, "position": pos, "team": team, "season_type": "REG",
                               "season": season, "week": week, **stats, **{c: None for c in PUNTS}})
                snaps.append((f"pfr{pid}", "REG", season, rng.random()))
            rosters.append((pid, name, team, pos, "ACT", season, 1, season - rookie, 25.0, 10.0))
            if season < 2022:
                charts.append((season, 1, str(rng.randrange(1, 3)), team, pid, name, pos, pos, "Offense"))
    for pid, _, pos, team, rookie in players:  # the season ahead
        rosters.append((pid, "x", team, pos, "ACT", 2024, 1, 2024 - rookie, 25.0, 10.0))
    plays = []
    for k in range(18):
        pid, team = f"00-9{k:06d}", TEAMS[k % 6]
        for season in SEASONS:
            team = rng.choice(TEAMS) if rng.random() < 0.3 else team
            rosters.append((pid, f"Punter {k}", team, "P", "ACT", season, 1, 3, 30.0, None))
            for week in range(1, rng.randrange(7, 12)):
                att = rng.randrange(1, 8)
                weekly.append({"player_id": pid, "player_display_name": f"Punter {k}", "position": "P", "team": team, "season_type": "REG",
                               "season": season, "week": week, **{c: None for c in STATS}, "fantasy_points_ppr": None,
                               "pt_att": float(att), "pt_yards": att * rng.uniform(38, 48), "pt_inside_20": float(rng.randrange(att + 1)),
                               "pt_blocked": 0.0, "pt_returned": 1.0, "pt_touchback": 0.0, "pt_fair_caught": 1.0, "pt_net_yards": att * 40.0})
                plays.append((f"g{season}{week}", "REG", team, TEAMS[(TEAMS.index(team) + 1) % 6], pid, season, week, float(rng.randrange(45, 95)),
                              float(rng.randrange(30, 60)), None, 0.0, float(rng.randrange(2)), 0.0, 0.0, 0.0, float(rng.randrange(2)), None))
        rosters.append((pid, f"Punter {k}", team, "P", "ACT", 2024, 1, 3, 30.0, None))
    schedule = [(s, w, "REG", f"{s}-09-{w + 3:02d}", TEAMS[i], TEAMS[(i + w) % 6], 20.0, 17.0)
                for s in SEASONS for w in range(1, 12) for i in range(0, 6, 2) if TEAMS[i] != TEAMS[(i + w) % 6]]
    ids = [(p, n, pos, n.lower(), f"pfr{p}", float(i), float(i + 1000), float(i + 2000)) for i, (p, n, pos, _, _) in enumerate(players)]
    adp = [(s, n + " Jr.", pos, float(rng.randrange(1, 200))) for s in range(2015, 2025) for _, n, pos, _, _ in players if rng.random() < 0.8]
    ngs = []
    for p, _, pos, team, _ in players:
        for s in SEASONS:
            kind = "rushing" if pos == "RB" else "receiving"
            ngs.append((kind, "REG", p, pos, team, s, 0, rng.random() * 4, rng.random(), 40.0, 30.0, rng.uniform(-30, 60), 50.0))
            ngs.append((kind, "REG", p, pos, team, s, 3, 1.0, 1.0, 4.0, 3.0, 1.0, 5.0))
    weekly_schema = "player_id string, player_display_name string, position string, team string, season_type string, season long, week long, " + ", ".join(
        f"{c} double" for c in [*STATS, "fantasy_points_ppr", *PUNTS])
    names = [c.split()[0] for c in weekly_schema.split(", ")]
    make = spark.createDataFrame
    return {
        "weekly_stats": make([tuple(r[n] for n in names) for r in weekly], weekly_schema),
        "schedules": make(schedule, "season long, week long, game_type string, gameday string, home_team string, away_team string, home_score double, away_score double"),
        "rosters": make(rosters, "player_id string, player_name string, team string, position string, status string, season long, week long, years_exp long, age double, draft_number double"),
        "snap_counts": make(snaps, "pfr_player_id string, game_type string, season long, offense_pct double"),
        "depth_charts": make(charts, "season long, week long, depth_team string, club_code string, gsis_id string, full_name string, position string, depth_position string, formation string"),
        "depth_chart_snapshots": make(
            [(f"{s}-09-0{d}T07:00:00Z", team, p, n, "3WR 1TE", pos, str(r % 3 + 1), s) for s in (2022, 2023) for d in (1, 3)
             for r, (p, n, pos, team, rookie) in enumerate(players)],
            "dt string, team string, gsis_id string, player_name string, pos_grp string, pos_abb string, pos_rank string, season long"),
        "players": make([(p, f"{1990 + i % 12}-05-0{i % 9 + 1}" if i % 11 else "n/a", float(r), None if i % 5 == 0 else float(i)) for i, (p, _, _, _, r) in enumerate(players)],
                        "gsis_id string, birth_date string, rookie_season double, draft_pick double"),
        "ids": make(ids, "gsis_id string, name string, position string, merge_name string, pfr_id string, espn_id double, sleeper_id double, cbs_id double"),
        "ngs_data": make(ngs, "stat_type string, season_type string, player_gsis_id string, player_position string, team_abbr string, season long, week long, avg_separation double, avg_yac_above_expectation double, targets double, receptions double, rush_yards_over_expected double, rush_attempts double"),
        "pfr_advstats_pass": make([(s, t, float(rng.randrange(50, 90)), 500.0) for s in SEASONS for t in TEAMS + ["2TM"]], "season long, team string, times_pressured double, pass_attempts double"),
        "pfr_advstats_rush": make([(s, t, "RB", float(rng.randrange(400, 900)), 400.0) for s in SEASONS for t in ["KC", "LA", "BUF", "LV", "GB"]], "season long, tm string, pos string, ybc double, att double"),
        "pbp_punts": make(plays, "game_id string, season_type string, posteam string, defteam string, punter_player_id string, season long, week long, yardline_100 double, kick_distance double, return_yards double, touchback double, punt_inside_twenty double, punt_in_endzone double, punt_out_of_bounds double, punt_downed double, punt_fair_catch double, punt_blocked double"),
        "ranked_adp": make(adp, "season long, name string, position string, adp double"),
        "mock_adp": make([(s, n, pos, a + 2, f) for s, n, pos, a in adp for f in ("ppr", "standard")], "season long, name string, position string, adp double, scoring_format string"),
    }


@pytest.fixture(scope="module")
def gold(spark, silver):
    ids = silver["ids"]
    feed = ids.select("espn_id", "position", F.lit(2024).alias("season"), (F.col("espn_id") * 2).alias("projected_points"), F.lit("ppr").alias("scoring"))
    feed = feed.unionByName(feed.withColumn("scoring", F.lit("standard")).withColumn("projected_points", F.lit(9999.0)))
    text = ids.select(F.col("sleeper_id").cast("string").alias("sleeper_id"), "position", F.lit("2024").alias("season"), F.lit(4.0).alias("projected_points"), F.lit(1).alias("week"))
    units = spark.createDataFrame([("Texans D/ST", "DST", 100.0), ("LAR", "DEF", 90.0), ("Rams", "DST", 80.0)], "team string, position string, projected_points double")
    outside = spark.createDataFrame([("00-9000000", 0.0), ("00-9000001", 120.0)], "entity_id string, projected_points double")
    return warehouse.build(
        silver, [league("alpha", 4, 0), league("beta", 3, 1)], "alpha", "alpha", 2024, [2022, 2023],
        {"first": feed, "second": text.unionByName(text.withColumn("week", F.lit(2)))}, {"first": units}, outside, punt_first_fold=2020, maxIter=2, minInstancesPerNode=5,
    )


def test_every_table_has_rows(gold):
    assert len(gold) == 19
    for name, df in gold.items():
        assert df.count() > 0, name


def test_keys_are_unique(gold):
    keys = {
        "adp_consensus": ["gsis_id", "season"], "player_weighted_baselines": ["target_season", "player_id"],
        "points_over_replacement": ["league_key", "season", "player_id"], "boom_bust": ["league_key", "season", "player_id"],
        "draft_value": ["league_key", "season", "player_id"], "player_archetypes": ["league_key", "season", "player_id"],
        "inhouse_projections": ["target_season", "player_id"], "punter_seasons": ["season", "entity_id"],
        "punter_projections": ["entity_id"], "consensus_projections": ["gsis_id"], "punt_environment": ["team", "season"],
    }
    for name, key in keys.items():
        assert gold[name].groupBy(*key).count().where("count > 1").count() == 0, name


def test_relations_between_tables(gold):
    grades = gold["offensive_line_grades"]
    # the franchise that moved meets itself under one code; a team without runs still ranks
    assert grades.where("team = 'OAK'").count() == 0 and grades.where("team = 'LV' AND run_block_ybc_per_att IS NULL").count() == 0
    assert grades.where("team = 'NYJ' AND run_block_ybc_per_att IS NULL AND run_block_grade = 100").count() == 9
    buckets = gold["boom_bust"]
    assert buckets.count() == gold["points_over_replacement"].count()
    assert buckets.where("(price IS NULL) <> (outcome_bucket = 'No Preseason ADP')").count() == 0
    value = gold["draft_value"]
    assert value.where("season = 2024 AND actual_value IS NOT NULL").count() == 0 and value.where("season = 2024").count() > 0
    assert value.where("actual_value < 0 OR (season < 2018 AND expected_value IS NOT NULL)").count() == 0
    assert gold["player_archetypes"].where("archetype IS NULL").count() == 0
    projected = gold["inhouse_projections"]
    assert {r[0] for r in projected.select("arm").distinct().collect()} == {"baseline", "no_baseline"}
    assert projected.where("role_games > season_games").count() == 0
    punters = {r["entity_id"]: r for r in gold["punter_projections"].collect()}
    assert punters["00-9000000"]["projected_points_outside"] is None
    one = punters["00-9000001"]
    assert one["projected_points_blended"] == pytest.approx((one["projected_points"] + 120.0) / 2)
    assert {r[0] for r in gold["punter_backtest"].select("prediction").distinct().collect()} == {"model", "prior_points", "prior_ppg", "league_mean"}
    constant = gold["punter_backtest"].where("prediction = 'league_mean' AND (spearman IS NOT NULL OR top5_hits IS NOT NULL)")
    assert constant.count() == 0
    teams = {r["team"]: r for r in gold["consensus_dst_projections"].collect()}
    assert teams["LA"]["first_points"] == 170.0 and teams["HOU"]["num_sources"] == 1
    players = gold["consensus_projections"]
    wrong = players.where("num_sources <> int(first_points IS NOT NULL) + int(second_points IS NOT NULL) + int(inhouse_points IS NOT NULL)")
    assert wrong.count() == 0 and players.where("second_points <> 8.0").count() == 0
    # one scoring counts, weeks are summed, and the labels come along
    assert players.where("max_points >= 9999").count() == 0
    assert players.where("player_name IS NULL OR position IS NULL").count() == 0
