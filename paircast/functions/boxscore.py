"""Row-wise box-score ratios and side flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nonzero(divisor: Column) -> Column:
    """A divisor where zero counts as one (not as missing)."""
    return F.when(divisor == 0, F.lit(1.0)).otherwise(divisor)


def shooting_possessions() -> Column:
    return F.col("fga") + 0.44 * F.col("fta")


# Ratio name -> expression over the raw box score.
FOUR_FACTORS = {
    "efg_pct": lambda: (F.col("fgm") + 0.5 * F.col("fg3m")) / nonzero(F.col("fga")),
    "tov_pct": lambda: F.col("tov") / nonzero(shooting_possessions() + F.col("tov")),
    "oreb_pct": lambda: F.col("oreb") / nonzero(F.col("oreb") + F.col("dreb")),
    "ft_rate": lambda: F.col("fta") / nonzero(F.col("fga")),
    "ts_pct": lambda: F.col("pts") / nonzero(2 * shooting_possessions()),
}
ADVANCED_METRICS = {
    "pace": lambda: shooting_possessions() - F.col("oreb") + F.col("tov"),
    "ast_to_ratio": lambda: F.col("ast") / nonzero(F.col("tov")),
    "reb_diff": lambda: F.col("reb") - (F.col("oreb") + F.col("dreb")),
    "fg3a_rate": lambda: F.col("fg3a") / nonzero(F.col("fga")),
}


def home_flag(matchup: Column) -> Column:
    """1 when the match-up text names a home side, 0 otherwise or when missing."""
    return F.coalesce(F.lower(matchup).contains("vs."), F.lit(False)).cast("int")


def away_flag(matchup: Column) -> Column:
    return F.coalesce(matchup.contains("@"), F.lit(False)).cast("int")


def win_flag(result: Column) -> Column:
    """1 for a win; a loss or a missing result is 0."""
    return F.when(result == "W", 1).otherwise(0)


def fatigue_score(days_rest: Column, back_to_back: Column, three_in_four: Column) -> Column:
    """0 (rested) to 1 (exhausted)."""
    rest = F.when(days_rest == 0, 0.4).when(days_rest == 1, 0.2).otherwise(0.0)
    tight = F.when(back_to_back == 1, 0.3).otherwise(0.0)
    dense = F.when(three_in_four == 1, 0.3).otherwise(0.0)
    return F.least(rest + tight + dense, F.lit(1.0))


def season_label(day: Column) -> Column:
    """Season of a date: it starts in October and is written YYYY-YY."""
    start = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    end = F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    return F.concat_ws("-", start.cast("string"), end)


def today_in(zone: str = "America/New_York") -> Column:
    """The current date in a named time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    )))
