"""Lookup tables, patterns and constants that results depend on.

They must equal the published conventions they describe; nothing here is logic.
"""

# Team nickname -> code.
TEAM_CODES = {
    "Cardinals": "ARI", "Falcons": "ATL", "Ravens": "BAL", "Bills": "BUF",
    "Panthers": "CAR", "Bears": "CHI", "Bengals": "CIN", "Browns": "CLE",
    "Cowboys": "DAL", "Broncos": "DEN", "Lions": "DET", "Packers": "GB",
    "Texans": "HOU", "Colts": "IND", "Jaguars": "JAX", "Chiefs": "KC",
    "Chargers": "LAC", "Rams": "LA", "Raiders": "LV", "Dolphins": "MIA",
    "Vikings": "MIN", "Patriots": "NE", "Saints": "NO", "Giants": "NYG",
    "Jets": "NYJ", "Eagles": "PHI", "Steelers": "PIT", "Seahawks": "SEA",
    "49ers": "SF", "Buccaneers": "TB", "Titans": "TEN", "Commanders": "WAS",
}

# Other spellings and former codes -> code.
TEAM_ALIASES = {
    "LAR": "LA", "JAC": "JAX", "WSH": "WAS", "GNB": "GB", "NOR": "NO",
    "SFO": "SF", "TAM": "TB", "NWE": "NE", "KAN": "KC", "LVR": "LV",
    "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU",
    "OAK": "LV", "SD": "LAC", "SDG": "LAC", "STL": "LA", "SL": "LA",
}

# Patterns of the source formats.
NAME_SUFFIX = r"(?i)\s+(jr|sr|ii|iii|iv|v)\.?$"
NAME_PUNCTUATION = "[.'’]"
PACKED_NAME = r"^(.+?)(?:\s{2,}(?:([A-Z]{2,3})\s)?\((\d+)\))?$"
LETTERS_RANK = r"^([A-Z]+?)(\d+)?$"
EMBEDDED_JSON = r"(?s)var {name} = (\{{.*?\}});"

# Scoring stat ids and lineup slot ids of the settings feed.
SCORING_STAT_IDS = {
    "pass_yd_pts": 3, "pass_td_pts": 4, "pass_2pt_pts": 19, "pass_int_pts": 20,
    "rush_yd_pts": 24, "rush_td_pts": 25, "rush_2pt_pts": 26, "rec_pts": 53,
    "rec_yd_pts": 42, "rec_td_pts": 43, "rec_2pt_pts": 44, "fum_lost_pts": 72,
}
PUNT_STAT_IDS = {
    "punt_pts": 138, "punt_in10_pts": 140, "punt_in20_pts": 141, "punt_blocked_pts": 142,
    "punt_returned_pts": 143, "punt_touchback_pts": 145, "punt_fair_catch_pts": 146,
    "punt_avg44_pts": 148, "punt_avg42_pts": 149, "punt_avg40_pts": 150,
}
LINEUP_SLOT_IDS = {
    "qb_slots": "0", "rb_slots": "2", "wr_slots": "4", "te_slots": "6", "flex_slots": "23",
    "superflex_slots": "7", "k_slots": "17", "p_slots": "18", "dst_slots": "16",
    "bench_slots": "20", "ir_slots": "21",
}
ROSTER_SLOT_NAMES = {
    "qb_slots": "QB", "rb_slots": "RB", "wr_slots": "WR", "te_slots": "TE",
    "flex_slots": "FLEX", "superflex_slots": "SUPER_FLEX", "k_slots": "K", "p_slots": "P",
    "dst_slots": "DEF", "bench_slots": "BN", "ir_slots": "IR",
}
POSITION_IDS = {1: "QB", 2: "RB", 3: "WR", 4: "TE", 5: "K", 7: "P", 16: "DST"}

# Raw stat -> settings column that prices it.
STAT_COEFFICIENTS = {
    "passing_yards": "pass_yd_pts", "passing_tds": "pass_td_pts",
    "passing_2pt_conversions": "pass_2pt_pts", "passing_interceptions": "pass_int_pts",
    "rushing_yards": "rush_yd_pts", "rushing_tds": "rush_td_pts",
    "rushing_2pt_conversions": "rush_2pt_pts", "receptions": "rec_pts",
    "receiving_yards": "rec_yd_pts", "receiving_tds": "rec_td_pts",
    "receiving_2pt_conversions": "rec_2pt_pts",
}
FUMBLE_COLUMNS = ("sack_fumbles_lost", "rushing_fumbles_lost", "receiving_fumbles_lost")

# Tenths of weight by seasons back.
RECENCY_TENTHS = {1: 10, 2: 9, 3: 8, 4: 7}

# Outcome labels and the rate column each becomes.
OUTCOME_RATES = {
    "League Winner": "league_winner_rate",
    "Delivered": "delivered_rate",
    "Beat His Price": "beat_price_rate",
    "Met His Price": "met_price_rate",
    "Fine": "fine_rate",
    "Busted": "busted_rate",
    "Got Injured": "injured_rate",
    "Never Had The Job": "never_had_job_rate",
}

# Shrinkage grids in units of prior evidence.
RATE_GRID = (10, 25, 50, 100, 200, 400, 800, 1600, 3200)
TEAM_GRID = (2, 4, 8, 16, 32, 64, 128)

# Opening and roster caps by position.
OPENING_CAPS = {"QB": 2, "RB": 5, "WR": 5, "TE": 2}
ROSTER_CAPS = {"QB": 2, "RB": 7, "WR": 7, "TE": 3}
SUPERFLEX_QB_CAP = 4

# Table-name prefixes of the loaded (silver) layer.
SILVER_PREFIXES = (
    "weekly_stats", "schedules", "rosters", "snap_counts", "injuries", "depth_chart", "ids",
    "players", "ngs_", "ftn_", "pbp_", "pfr_advstats", "sleeper_", "espn_", "fantasypros_",
    "ffc_", "fftoday_", "cbs_",
)

# Box-score columns that are summed and averaged, as the feed names them.
TOTALS = {
    "targets": "targets", "receptions": "receptions", "receiving_yards": "receiving_yards",
    "receiving_tds": "receiving_tds", "carries": "carries", "rushing_yards": "rushing_yards",
    "rushing_tds": "rushing_tds", "pass_attempts": "attempts", "passing_yards": "passing_yards",
    "passing_tds": "passing_tds", "passing_interceptions": "passing_interceptions",
}
AVERAGES = (
    "target_share", "air_yards_share", "wopr", "passing_epa", "rushing_epa", "receiving_epa", "passing_cpoe",
)

# Feature names of the boosted models, as the derived tables name them.
RATE_INPUTS = (
    "weighted_ppg_ppr", "weighted_games_per_season", "seasons_used", "ol_grade", "skill_grade", "seasons_of_experience",
    "age_at_season", "draft_pick", "target_is_starter", "changed_team",
)
GAMES_INPUTS = (
    "weighted_games_per_season", "seasons_used", "seasons_of_experience", "age_at_season", "draft_pick",
    "weeks_on_depth_chart", "starter_share", "end_starter", "target_is_starter",
)
NEW_RATE_INPUTS = (
    "draft_number", "age_at_season", "seasons_of_experience", "career_ppg", "career_games", "ol_grade", "skill_grade",
    "target_is_starter",
)
NEW_GAMES_INPUTS = ("draft_number", "age_at_season", "seasons_of_experience", "career_games", "target_is_starter")
