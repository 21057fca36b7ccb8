"""The long contest log: ratios, flags, validity, sides and look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.functions.boxscore import ADVANCED_METRICS, FOUR_FACTORS, away_flag, home_flag, season_label


def four_factors(log: DataFrame) -> DataFrame:
    return log.withColumns({name: expr() for name, expr in FOUR_FACTORS.items()})


def advanced_metrics(log: DataFrame) -> DataFrame:
    return log.withColumns({name: expr() for name, expr in ADVANCED_METRICS.items()})


def with_ratios(log: DataFrame) -> DataFrame:
    """All ratios, for rows that were moved without them."""
    return advanced_metrics(four_factors(log))


def with_side_flags(log: DataFrame) -> DataFrame:
    return log.withColumns({"is_home": home_flag(F.col("matchup")), "is_away": away_flag(F.col("matchup"))})


def with_season(log: DataFrame) -> DataFrame:
    return log.withColumn("season", season_label(F.col("game_date")))


def in_season(log: DataFrame, season: str, exclude: bool = False) -> DataFrame:
    return log.filter(F.col("season") != season) if exclude else log.filter(F.col("season") == season)


def pair_sides(log: DataFrame, columns: list[str]) -> DataFrame:
    """One row per valid contest with the structs `home` and `away`.

    Valid means exactly two rows, one on each side. Both sides meet in a single
    aggregation on the contest key, so the log is shuffled once, not twice.
    """
    fields = F.struct(*[c for c in columns if c != "game_id"])
    flagged = log if "is_home" in log.columns and "is_away" in log.columns else with_side_flags(log)
    return (
        flagged.groupBy("game_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum("is_home").alias("_homes"),
            F.sum("is_away").alias("_aways"),
            F.first(F.when(F.col("is_home") == 1, fields), ignorenulls=True).alias("home"),
            F.first(F.when(F.col("is_away") == 1, fields), ignorenulls=True).alias("away"),
        )
        .filter("_rows = 2 and _homes = 1 and _aways = 1 and home is not null and away is not null")
        .select("game_id", "home", "away")
    )


def valid_contests(log: DataFrame) -> DataFrame:
    """Narrow table of valid contests, the input of ratings and head-to-head."""
    sides = pair_sides(log, ["team_id", "game_date", "season", "wl", "plus_minus"])
    return sides.select(
        "game_id",
        F.col("home.game_date").alias("game_date"),
        F.col("home.season").alias("season"),
        F.col("home.team_id").alias("home_team_id"),
        F.col("away.team_id").alias("away_team_id"),
        F.col("home.wl").alias("home_wl"),
        F.col("away.wl").alias("away_wl"),
        F.col("home.plus_minus").alias("home_plus_minus"),
        F.col("away.plus_minus").alias("away_plus_minus"),
    )


def all_present(columns: list[str]) -> Column:
    """Every column has a value, as separate conjuncts.

    One predicate over all columns (as `na.drop` builds it) makes constraint
    propagation double its work with every renamed column.
    """
    return reduce(lambda acc, c: acc & F.col(c).isNotNull(), columns[1:], F.col(columns[0]).isNotNull())


def ready_rows(features: DataFrame) -> DataFrame:
    """Rows whose rolling columns and win count are all present."""
    return features.filter(all_present([c for c in features.columns if "_roll_" in c or c == "win_streak"]))


def game_results(log: DataFrame, teams: DataFrame) -> DataFrame:
    """Winner per contest by name; the home result decides, log names fill gaps."""
    sides = pair_sides(log, ["team_id", "team_name", "game_date", "wl"])
    names = teams.select(F.col("id"), F.col("full_name"))
    home = names.select(F.col("id").alias("_home_id"), F.col("full_name").alias("_home_known"))
    away = names.select(F.col("id").alias("_away_id"), F.col("full_name").alias("_away_known"))
    return (
        sides.join(home, F.col("home.team_id") == F.col("_home_id"), "left")
        .join(away, F.col("away.team_id") == F.col("_away_id"), "left")
        .select(
            "game_id",
            F.col("home.game_date").alias("game_date"),
            F.coalesce("_home_known", "home.team_name").alias("home_team"),
            F.coalesce("_away_known", "away.team_name").alias("away_team"),
            F.col("home.wl").alias("_home_wl"),
        )
        .withColumn("winner", F.when(F.col("_home_wl") == "W", F.col("home_team")).otherwise(F.col("away_team")))
        .drop("_home_wl")
    )


def linescore_results(header: DataFrame, lines: DataFrame, teams: DataFrame) -> DataFrame:
    """Winners of final contests from two score lines; ties and gaps are skipped.

    The first line of a side (by `line_no`) counts and points that are not
    numbers are missing.
    """
    points = F.expr("try_cast(pts as double)")
    per_side = lines.groupBy("game_id", "team_id").agg(F.min_by(points, "line_no").alias("points"))
    finals = header.filter(F.col("game_status").contains("Final"))
    home = per_side.select("game_id", F.col("team_id").alias("home_team_id"), F.col("points").alias("home_pts"))
    away = per_side.select("game_id", F.col("team_id").alias("away_team_id"), F.col("points").alias("away_pts"))
    joined = (
        finals.join(home, ["game_id", "home_team_id"])
        .join(away, ["game_id", "away_team_id"])
        .filter("home_pts is not null and away_pts is not null and home_pts <> away_pts")
    )
    named = with_team_names(joined, teams, "full_name")
    return named.withColumn(
        "winner", F.when(F.col("home_pts") > F.col("away_pts"), F.col("home_team")).otherwise(F.col("away_team"))
    ).select("game_id", "game_date", "home_team", "away_team", "winner")


def with_team_names(games: DataFrame, teams: DataFrame, name_column: str) -> DataFrame:
    """Add home_team and away_team; an unknown id is shown as text."""
    home = teams.select(F.col("id").alias("home_team_id"), F.col(name_column).alias("_home_name"))
    away = teams.select(F.col("id").alias("away_team_id"), F.col(name_column).alias("_away_name"))
    show = lambda name, key: F.coalesce(F.col(name), F.col(key).cast("string"), F.lit("None"))
    return (
        games.join(home, "home_team_id", "left")
        .join(away, "away_team_id", "left")
        .withColumn("home_team", show("_home_name", "home_team_id"))
        .withColumn("away_team", show("_away_name", "away_team_id"))
        .drop("_home_name", "_away_name")
    )


def supplement(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """The primary rows plus the secondary rows whose key is new."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"))


def split_exhibition(games: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contests between known teams, and the others with display names."""
    ids = teams.select(F.col("id"))
    regular = games.join(ids.withColumnRenamed("id", "home_team_id"), "home_team_id", "left_semi").join(
        ids.withColumnRenamed("id", "away_team_id"), "away_team_id", "left_semi"
    )
    home = teams.select(F.col("id").alias("home_team_id"), F.col("full_name").alias("_home"))
    away = teams.select(F.col("id").alias("away_team_id"), F.col("full_name").alias("_away"))
    label = lambda key: F.concat(F.lit("Team #"), F.coalesce(F.col(key).cast("string"), F.lit("None")))
    skipped = (
        games.join(home, "home_team_id", "left")
        .join(away, "away_team_id", "left")
        .filter("_home is null or _away is null")
        .withColumn("home_name", F.coalesce("_home", label("home_team_id")))
        .withColumn("away_name", F.coalesce("_away", label("away_team_id")))
        .drop("_home", "_away")
    )
    return regular, skipped


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in an explicit order.

    A rank filter of one lets Spark trim every key before the shuffle.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def team_abbreviations(log: DataFrame) -> DataFrame:
    """The first abbreviation seen per team; a partial aggregate, no window."""
    return log.groupBy("team_id").agg(F.min_by("team_abbr", F.struct("game_date", "game_id")).alias("team_abbr"))


def repair_team_ids(board: DataFrame, log: DataFrame) -> DataFrame:
    """Fill missing ids of a board from the log; keys match without leading zeros."""
    bare = lambda c: F.regexp_replace(F.col(c).cast("string"), "^0+(?=.)", "")
    broken = board.filter("home_team_id is null or away_team_id is null").select(bare("game_id").alias("_key")).distinct()
    matchup, when = F.col("matchup"), F.struct("game_date", "team_id")
    known = (
        log.withColumn("_key", bare("game_id"))
        .join(broken, "_key", "left_semi")
        .groupBy("_key")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min_by(F.when(matchup.contains(" vs. "), F.col("team_id")), F.when(matchup.contains(" vs. "), when)).alias("_home"),
            F.min_by(F.when(matchup.contains(" @ "), F.col("team_id")), F.when(matchup.contains(" @ "), when)).alias("_away"),
            F.min("team_id").alias("_only"),
        )
        .select(
            "_key",
            F.when(F.col("_rows") == 1, F.col("_only")).otherwise(F.col("_home")).alias("_home"),
            F.when(F.col("_rows") > 1, F.col("_away")).alias("_away"),
        )
    )
    return (
        board.withColumn("_key", bare("game_id"))
        .join(known, "_key", "left")
        .withColumn("home_team_id", F.coalesce("home_team_id", "_home"))
        .withColumn("away_team_id", F.coalesce("away_team_id", "_away"))
        .drop("_key", "_home", "_away")
    )


def overlay_status(scheduled: DataFrame, live: DataFrame) -> DataFrame:
    """Live status wins over the scheduled one when the board is of the same day."""
    latest = live.select("game_id", F.col("board_date").alias("game_date"), F.col("live_status"))
    return (
        scheduled.join(latest, ["game_id", "game_date"], "left")
        .withColumn("game_status", F.coalesce("live_status", "game_status"))
        .drop("live_status")
    )


def lowest_priority(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the best source that has any for the key; sources best first.

    The winning source is found by a partial aggregate on the key alone, so
    the rows themselves are never gathered per key.
    """
    tagged = [df.withColumn("source_rank", F.lit(rank)) for rank, df in enumerate(sources, 1)]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df)
    best = merged.groupBy(*keys).agg(F.min("source_rank").alias("source_rank"))
    return merged.join(best, [*keys, "source_rank"], "left_semi")
