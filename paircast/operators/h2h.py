"""Head-to-head records of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.constants import H2H_DEFAULTS

MEETINGS = 10


def _pairs(contests: DataFrame) -> DataFrame:
    """Contests keyed by the unordered pair, with each member's view of them."""
    home_low = F.col("home_team_id") < F.col("away_team_id")
    pick = lambda a, b: F.when(home_low, F.col(a)).otherwise(F.col(b))
    won = lambda a, b: F.coalesce(pick(a, b) == "W", F.lit(False)).cast("int")
    return contests.select(
        F.least("home_team_id", "away_team_id").alias("low_id"),
        F.greatest("home_team_id", "away_team_id").alias("high_id"),
        "game_date",
        "game_id",
        won("home_wl", "away_wl").alias("low_won"),
        won("away_wl", "home_wl").alias("high_won"),
        pick("home_plus_minus", "away_plus_minus").alias("low_diff"),
        pick("away_plus_minus", "home_plus_minus").alias("high_diff"),
    )


def _record(wins: Column, met: Column, diff: Column) -> Column:
    """Win rate, meetings and mean difference; neutral values when they never met."""
    return F.struct(
        F.when(met > 0, wins / F.when(met > 0, met)).otherwise(0.5).alias("h2h_win_rate"),
        met.cast("int").alias("h2h_games"),
        F.when(met == 0, F.lit(0.0)).otherwise(diff).alias("h2h_pts_diff"),
    )


def pairs_asof(contests: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    """Both records of a pair over its last meetings strictly before a day.

    One row per unordered pair and day on which the pair meets. Only the newest
    meetings of a day are kept, and the rank filter trims them before the
    shuffle; each day adds at least one, so the newest ten lie within the ten
    previous days and no pair's history is ever collected.
    """
    newest = Window.partitionBy("low_id", "high_id", "game_date").orderBy(F.desc("game_id"))
    days = (
        _pairs(contests)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= meetings)
        .groupBy("low_id", "high_id", "game_date")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "low_won", "high_won", "low_diff", "high_diff"))).alias("_day"))
    )
    back = Window.partitionBy("low_id", "high_id").orderBy("game_date").rowsBetween(-meetings, -1)
    recent = F.slice(F.flatten(F.reverse(F.collect_list("_day").over(back))), 1, meetings)
    met = F.size("_past")
    wins = lambda side: F.aggregate("_past", F.lit(0), lambda acc, m: acc + m[f"{side}_won"])
    diffs = lambda side: F.filter(F.transform("_past", lambda m: m[f"{side}_diff"]), lambda v: v.isNotNull())
    return days.withColumn("_past", recent).select(
        "low_id",
        "high_id",
        "game_date",
        *[_record(wins(side), met, _mean(diffs(side))).alias(side) for side in ("low", "high")],
    )


def pairs_latest(contests: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    """Both records of a pair over its last meetings in the whole log.

    A missing difference counts as no difference here.
    """
    newest = Window.partitionBy("low_id", "high_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    met = F.count(F.lit(1))
    diff = lambda side: F.coalesce(F.avg(f"{side}_diff"), F.lit(0.0))
    return (
        _pairs(contests)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= meetings)
        .groupBy("low_id", "high_id")
        .agg(*[_record(F.sum(f"{side}_won"), met, diff(side)).alias(side) for side in ("low", "high")])
    )


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(values) > 0, total / F.when(F.size(values) > 0, F.size(values)))


def _by_direction(pairs: DataFrame) -> DataFrame:
    """One row per (team, opponent) instead of one per unordered pair."""
    view = lambda mine, other, side: F.struct(
        F.col(mine).alias("team_id"), F.col(other).alias("opp_id"), F.col(side).alias("record")
    )
    sides = F.array(view("low_id", "high_id", "low"), view("high_id", "low_id", "high"))
    rest = [c for c in pairs.columns if c not in ("low_id", "high_id", "low", "high")]
    return pairs.select(*rest, F.explode(sides).alias("_side")).select("_side.team_id", "_side.opp_id", *rest, "_side.record.*")


def h2h_asof(contests: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    return _by_direction(pairs_asof(contests, meetings))


def h2h_latest(contests: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    return _by_direction(pairs_latest(contests, meetings))


def with_h2h(contests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach both directions of the record to each contest, in one join.

    `pairs` comes from `pairs_asof` (joined by day too) or `pairs_latest`.
    """
    on = ["low_id", "high_id"] + (["game_date"] if "game_date" in pairs.columns else [])
    keyed = contests.withColumns(
        {"low_id": F.least("home_team_id", "away_team_id"), "high_id": F.greatest("home_team_id", "away_team_id")}
    )
    home_low = F.col("home_team_id") < F.col("away_team_id")
    filled = []
    for side, first, second in (("home", "low", "high"), ("away", "high", "low")):
        record = F.when(home_low, F.col(first)).otherwise(F.col(second))
        for name, default in H2H_DEFAULTS.items():
            value = F.when(F.col("low").isNull(), F.lit(default)).otherwise(record[name])
            filled.append(value.alias(f"{side}_{name}"))
    return keyed.join(pairs, on, "left").select(*contests.columns, *filled)
