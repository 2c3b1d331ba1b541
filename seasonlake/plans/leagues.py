"""Two settings rows over the driver tables and their DuckDB text."""

POSITIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
FLEX_POSITIONS = ("BUILDING", "FURNITURE", "HOUSEHOLD")
SLOTS = {
    "AUTOMOBILE": "automobile_slots", "BUILDING": "building_slots",
    "FURNITURE": "furniture_slots", "HOUSEHOLD": "household_slots",
}
FLEX = [("flex_slots", FLEX_POSITIONS)]
SETTINGS = [
    {"league_key": "alpha", "team_count": 12, "f_pts": 1.0, "o_pts": 0.5, "p_pts": 0.25,
     "miss_pts": -100000.0, "automobile_slots": 1, "building_slots": 2, "furniture_slots": 2,
     "household_slots": 1, "flex_slots": 2, "superflex_slots": 0, "bench_slots": 6},
    {"league_key": "beta", "team_count": 10, "f_pts": 0.5, "o_pts": 1.0, "p_pts": 1.0,
     "miss_pts": 0.0, "automobile_slots": 1, "building_slots": 2, "furniture_slots": 3,
     "household_slots": 1, "flex_slots": 1, "superflex_slots": 1, "bench_slots": 5},
]
FIELDS = list(SETTINGS[0])
REFERENCE = "alpha"


def _sql(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)


LG = "lg AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(_sql(s[f]) for f in FIELDS) + ")" for s in SETTINGS
) + f") AS v({', '.join(FIELDS)}))"
