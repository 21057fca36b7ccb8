"""The wide table: one row per contest with both sides' features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paircast.constants import FORM_COLUMNS, H2H_DEFAULTS, ROLLED_STATS, STANDINGS_DEFAULTS
from paircast.operators.form import form_features
from paircast.operators.games import all_present, ready_rows, valid_contests, with_ratios, with_side_flags
from paircast.operators.h2h import pairs_asof, with_h2h
from paircast.operators.standings import own_days, standings_asof, with_standings_diff

#: The columns that rolled statistics and their ratios are made of.
BOX_SCORE = (
    "pts", "fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct",
    "oreb", "dreb", "reb", "ast", "stl", "blk", "tov",
)


def side_features() -> list[str]:
    """The 45 form columns of one side."""
    rolled = [f"{s}_{kind}" for s in ROLLED_STATS for kind in ("roll_mean", "roll_std")]
    return rolled + list(FORM_COLUMNS)


def contest_columns() -> list[str]:
    """All 117 columns: 5 keys and labels, 112 features."""
    per_side = [f"{side}_{c}" for side in ("home", "away") for c in side_features()]
    h2h = [f"{side}_{c}" for side in ("home", "away") for c in H2H_DEFAULTS]
    table = [f"{side}_{c}" for side in ("home", "away") for c in STANDINGS_DEFAULTS]
    keys = ["game_id", "game_date", "home_team_id", "away_team_id", "home_win"]
    return keys + per_side + h2h + table + ["rank_diff", "win_pct_diff"]


def enriched_log(log: DataFrame, window: int = 20) -> DataFrame:
    """The log with ratios and all form columns."""
    return form_features(log, window=window, derive=with_ratios)


def narrow_log(log: DataFrame) -> DataFrame:
    """What a contest needs of the log: the keys, the result, the sides as flags and the box score."""
    used = ["game_id", "game_date", "team_id", "wl", *BOX_SCORE]
    return with_side_flags(log).select(*[c for c in used if c in log.columns], "is_home", "is_away")


def matched_sides(features: DataFrame, extra: tuple[str, ...] = (), complete: bool = False) -> DataFrame:
    """Home and away form of each valid contest, prefixed, with the label.

    Each side's row is the only one of its side, so its columns are picked one
    by one: a reader moves only those that it asks for. With `complete`, contests
    with a missing value on a side are dropped.
    """
    columns = [c for c in side_features() if c in features.columns] + list(extra)
    ready = ready_rows(features)
    rows = ready if "matchup" not in ready.columns else with_side_flags(ready)
    rows = rows.withColumns({"_won": F.coalesce(F.col("wl") == "W", F.lit(False)), "_whole": all_present(columns) if complete else F.lit(True)})
    only = lambda c, flag, name: F.max(F.when(F.col(flag) == 1, F.col(c))).alias(name)
    # Sides meet as plain rows: a partial aggregate would fold nothing, as they come from different entities.
    sides = (
        rows.repartition("game_id")
        .groupBy("game_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum("is_home").alias("_homes"),
            F.sum("is_away").alias("_aways"),
            only("game_date", "is_home", "game_date"),
            only("team_id", "is_home", "home_team_id"),
            only("team_id", "is_away", "away_team_id"),
            only("_won", "is_home", "_home_won"),
            *[only("_whole", f"is_{side}", f"_{side}_whole") for side in ("home", "away")],
            *[only(c, f"is_{side}", f"{side}_{c}") for side in ("home", "away") for c in columns],
        )
        .filter("_rows = 2 and _homes = 1 and _aways = 1 and _home_whole and _away_whole")
    )
    prefixed = [f"{side}_{c}" for side in ("home", "away") for c in columns]
    return sides.select("game_id", "game_date", "home_team_id", "away_team_id", F.when(F.col("_home_won"), 1).otherwise(0).alias("home_win"), *prefixed)


def meetings(log: DataFrame) -> DataFrame:
    """Each home row with each away side of its contest, once; one row for a valid contest."""
    home = F.when(F.col("is_home") == 1, F.struct(F.col("team_id").alias("home_team_id"), "game_date"))
    away = F.when(F.col("is_away") == 1, F.col("team_id"))
    sides = log.groupBy("game_id").agg(F.collect_set(home).alias("_home"), F.collect_set(away).alias("_away"))
    each = sides.select("game_id", F.explode("_home").alias("_home"), "_away")
    return each.select("game_id", "_home.*", F.explode("_away").alias("away_team_id"))


def contest_table(log: DataFrame, conference: Column, window: int = 20, cohort: str | None = None) -> DataFrame:
    """Form, head-to-head and standings of both sides of every valid contest.

    Rows with any missing feature are dropped. What a row needs beside its form
    is joined where rows are narrow: standings to the offsets of days, head-to-head
    to the meetings. Wide rows are moved once, to meet in their contest.
    """
    table = standings_asof(log, conference, cohort, own_days(log, cohort))
    plain = narrow_log(log)
    standings = table.select("team_id", "game_date", *STANDINGS_DEFAULTS)
    features = form_features(plain, window=window, ewm=False, derive=with_ratios, beside=standings)
    filled = features.withColumns({c: F.coalesce(c, F.lit(value)) for c, value in STANDINGS_DEFAULTS.items()})
    contests = with_standings_diff(matched_sides(filled, tuple(STANDINGS_DEFAULTS), complete=True))
    records = with_h2h(meetings(plain), pairs_asof(valid_contests(log)))
    # Only the contest is a key of the join, as both sides are dealt by it; array_contains compares without becoming one.
    met = records.select(F.col("game_id").alias("_game"), F.col("game_date").alias("_day"), F.col("home_team_id").alias("_home"), F.col("away_team_id").alias("_away"), *_H2H)
    same = F.col("game_id") == F.col("_game")
    for own, other in (("game_date", "_day"), ("home_team_id", "_home"), ("away_team_id", "_away")):
        same = same & F.array_contains(F.array(own), F.col(other))
    kept = ["game_id", "game_date", "home_team_id", "away_team_id", *_H2H]
    return contests.join(met, same).select(*contest_columns()).filter(all_present(kept))


_H2H = [f"{side}_{c}" for side in ("home", "away") for c in H2H_DEFAULTS]
