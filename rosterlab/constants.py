"""Fixed values of the roster game and of its feeds."""

# Team code spellings and the code used throughout.
TEAM_ALIASES = {
    "ARZ": "ARI",
    "GNB": "GB",
    "JAC": "JAX",
    "LA": "LAR",
    "LVR": "LV",
    "OAK": "LV",
    "SD": "LAC",
    "SFO": "SF",
    "STL": "LAR",
    "TAM": "TB",
    "WSH": "WAS",
}

# Roster rules.
SALARY_CAP = 50000
ROSTER_SIZE = 9
POSITIONS = ("QB", "RB", "WR", "TE", "DST")
POSITION_MINIMUMS = {"QB": 1, "RB": 2, "WR": 3, "TE": 1, "DST": 1}
POSITION_MAXIMUMS = {"QB": 1, "RB": 3, "WR": 4, "TE": 2, "DST": 1}
FLEX_POSITIONS = ("RB", "WR", "TE")
SKILL_SLOTS = 7
SLOT_NAMES = ("QB", "RB", "WR", "TE", "FLEX", "DST")

# Sentinels at the output edge.
UNKNOWN_OPPONENT = "UNK"
PLACEHOLDER_SALARY = 2500

# Name words.
NAME_SUFFIX_WORDS = ("jr", "sr", "ii", "iii", "iv")
DISPLAY_SUFFIXES = (" Jr.", " Sr.", " III", " IV", " V")
SPECIAL_NAME_CHARACTERS = ("'", "-", ".", " ")
DEFENSE_WORDS = ("dst", "def", "defense")

# Identity sources.
SALARY_SOURCE = "draftkings"
STATS_SOURCE = "nfl_api"
ABBREVIATION_CONFIDENCE = 0.9

# Salary bands of the projection noise (upper bound is exclusive, then inclusive).
NOISE_LOW_SALARY, NOISE_HIGH_SALARY = 4500, 6500
NOISE_BANDS = (0.08, 0.04, 0.02)
NOISE_BASE_ALPHA = 0.04

# Constant projections.
DEFENSE_PROJECTION = 10.0
LINEAR_FALLBACK_WEIGHT = 0.01
DEFENSE_PLACEHOLDERS = {
    "sacks_avg": 2.1,
    "takeaways_avg": 1.0,
    "opp_points_allowed": 22.0,
    "opp_sacks_allowed": 2.5,
}

# Features each position's model needs.
FEATURE_CONTRACT = {
    "QB": ["fp_avg_3", "passing_yards_avg"],
    "RB": ["fp_avg_3", "rush_yards_avg"],
    "WR": ["fp_avg_3", "targets_avg"],
    "TE": ["fp_avg_3", "targets_avg"],
    "DST": ["sacks_avg", "takeaways_avg", "opp_points_allowed", "opp_sacks_allowed"],
}
TRAINING_FEATURES = {
    "QB": ["fp_avg_3", "passing_yards_avg"],
    "RB": ["fp_avg_3", "rush_yards_avg"],
    "WR": ["fp_avg_3", "targets_avg"],
    "TE": ["fp_avg_3", "targets_avg"],
    "DST": ["fp_avg_3", "sacks_avg", "interceptions_avg", "fumbles_avg", "tds_avg"],
}
MIN_TRAINING_ROWS = {"QB": 500, "RB": 500, "WR": 500, "TE": 500, "DST": 100}

# Salary tiers per position, dearest first:
# (lowest salary, points, passing yards, rushing yards, targets).
SALARY_TIERS = {
    "QB": [(7000, 22.0, 280.0, 15.0, 0.0), (6000, 18.0, 250.0, 15.0, 0.0), (5000, 15.0, 220.0, 15.0, 0.0), (None, 12.0, 190.0, 15.0, 0.0)],
    "RB": [(7000, 20.0, 0.0, 100.0, 5.0), (6000, 16.0, 0.0, 80.0, 4.0), (5000, 13.0, 0.0, 65.0, 3.0), (None, 10.0, 0.0, 50.0, 2.0)],
    "WR": [(7000, 18.0, 0.0, 5.0, 9.0), (6000, 15.0, 0.0, 5.0, 7.0), (5000, 12.0, 0.0, 5.0, 5.0), (None, 9.0, 0.0, 5.0, 3.0)],
    "TE": [(6000, 15.0, 0.0, 2.0, 8.0), (5000, 12.0, 0.0, 2.0, 6.0), (4000, 9.0, 0.0, 2.0, 4.0), (None, 6.0, 0.0, 2.0, 2.0)],
}
# Fixed values: (low, high) bounds per position for points, passing yards, rushing yards and targets.
TIER_BOUNDS = {
    "QB": {"fp_avg_3": (8.0, 30.0), "passing_yards_avg": (150.0, 350.0)},
    "RB": {"fp_avg_3": (5.0, 28.0), "rush_yards_avg": (20.0, 150.0), "targets_avg": (0.5, 8.0)},
    "WR": {"fp_avg_3": (4.0, 25.0), "targets_avg": (1.0, 12.0)},
    "TE": {"fp_avg_3": (3.0, 22.0), "targets_avg": (0.5, 10.0)},
}
TIER_LABELS = ("elite", "mid", "value", "cheap")

# Source-specific spellings of a player's name.
NAME_MAP = [
    ("DraftKings", "Cooper Kupp", "Cooper Kupp"),
    ("FanDuel", "C. Kupp", "Cooper Kupp"),
    ("ESPN", "Kupp", "Cooper Kupp"),
    ("DraftKings", "Christian McCaffrey", "Christian McCaffrey"),
    ("FanDuel", "C. McCaffrey", "Christian McCaffrey"),
    ("ESPN", "CMC", "Christian McCaffrey"),
]
