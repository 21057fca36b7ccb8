"""Fixed values of the data model."""

# The 18 box-score and ratio columns that get rolling features.
ROLLED_STATS = (
    "pts", "fg_pct", "fg3_pct", "ft_pct", "reb", "ast", "tov", "stl", "blk",
    "efg_pct", "tov_pct", "oreb_pct", "ft_rate", "ts_pct",
    "pace", "ast_to_ratio", "reb_diff", "fg3a_rate",
)

# Non-rolled form columns carried into the contest table.
FORM_COLUMNS = (
    "win_streak", "recent_form", "win_pattern_3game", "momentum_trend",
    "win_consistency", "is_home", "days_rest", "is_back_to_back", "is_3_in_4",
)

# Standings columns and what an entity without a record gets.
STANDINGS_DEFAULTS = {
    "wins": 0,
    "losses": 0,
    "win_pct": 0.5,
    "conf_rank": 8,
    "league_rank": 15,
    "games_back": 0.0,
    "streak": 0,
}

# Head-to-head columns and what a pair that never met gets.
H2H_DEFAULTS = {"h2h_win_rate": 0.5, "h2h_games": 0, "h2h_pts_diff": 0.0}

# Serving defaults, looked up by the first key that the column
# name contains; the keys say ROLL_AVG while trained columns say ROLL_MEAN, so
# only the non-rolled keys ever match a trained column.
SERVING_DEFAULTS = (
    ("roll_avg_pts", 110.0),
    ("roll_avg_fg_pct", 0.46),
    ("roll_avg_fg3_pct", 0.36),
    ("roll_avg_reb", 44.0),
    ("roll_avg_ast", 25.0),
    ("roll_avg_stl", 7.5),
    ("roll_avg_blk", 5.0),
    ("roll_avg_tov", 13.5),
    ("roll_avg_plus_minus", 0.0),
    ("win_streak", 0.0),
    ("recent_form", 0.5),
    ("momentum_trend", 0.0),
    ("days_rest", 2.0),
    ("is_back_to_back", 0.0),
    ("is_3_in_4", 0.0),
)

# Confidence tiers, best first, with their inclusive lower edge.
TIERS = (
    ("EXCELLENT", 0.50),
    ("STRONG", 0.40),
    ("GOOD", 0.30),
    ("MODERATE", 0.20),
    ("RISKY", 0.10),
    ("SKIP", None),
)

# Half-open report buckets [low, high) with their labels.
CONFIDENCE_BUCKETS = (
    (0.45, 1.00, "45%+"),
    (0.40, 0.45, "40-45%"),
    (0.35, 0.40, "35-40%"),
    (0.30, 0.35, "30-35%"),
    (0.25, 0.30, "25-30%"),
    (0.20, 0.25, "20-25%"),
    (0.15, 0.20, "15-20%"),
    (0.10, 0.15, "10-15%"),
    (0.05, 0.10, "5-10%"),
    (0.00, 0.05, "<5%"),
)
CONFIDENCE_BUCKETS_COARSE = (
    (0.4, 1.0, "40%+"),
    (0.3, 0.4, "30-40%"),
    (0.2, 0.3, "20-30%"),
    (0.1, 0.2, "10-20%"),
    (0.0, 0.1, "<10%"),
)
AGREEMENT_BUCKETS = (
    (0.98, 1.01, "98%+"),
    (0.95, 0.98, "95-98%"),
    (0.92, 0.95, "92-95%"),
    (0.90, 0.92, "90-92%"),
    (0.85, 0.90, "85-90%"),
    (0.00, 0.85, "<85%"),
)
AGREEMENT_BUCKETS_COARSE = (
    (0.95, None, "95%+ agree"),
    (0.90, 0.95, "90-95% agree"),
    (None, 0.90, "<90% agree"),
)
HOME_PROB_BUCKETS = (
    (0.75, 1.00, "75%+ home"),
    (0.65, 0.75, "65-75% home"),
    (0.55, 0.65, "55-65% home"),
    (0.45, 0.55, "45-55% toss"),
    (0.35, 0.45, "55-65% away"),
    (0.25, 0.35, "65-75% away"),
    (0.00, 0.25, "75%+ away"),
)
TRAILING_PERIODS = (
    (3, "Last 3 days"),
    (7, "Last 7 days"),
    (14, "Last 14 days"),
    (30, "Last 30 days"),
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# The price columns of one contest.
ODDS_COLUMNS = (
    "home_avg_odds", "away_avg_odds",
    "home_best_odds", "away_best_odds",
    "home_worst_odds", "away_worst_odds",
    "home_odds_spread", "away_odds_spread",
    "home_implied_prob", "away_implied_prob",
    "bookmaker_count",
)

# The pay-off model behind the return figures.
WIN_PROFIT = 0.41
BREAK_EVEN_ACCURACY = 70.9
MIN_FILTER_GAMES = 5
FAVORITE_HIGH = 0.75
FAVORITE_LOW = 0.25

# The rating system.
ELO_K = 20.0
ELO_START = 1500.0
ELO_HOME_BONUS = 100.0
ELO_SEASON_KEEP = 0.75

# Columns of the contest table that are never model features.
NON_FEATURES = ("home_win", "game_id", "game_date", "home_team_id", "away_team_id")

# Words ignored when names are compared.
ARTICLES = ("the", "a", "an")
