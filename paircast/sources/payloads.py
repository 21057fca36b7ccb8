"""Nested JSON payloads to rows.

Every function takes a frame with one payload per row (landed files read with
`spark.read.text(.., wholetext=True)`, or a table column) and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paircast.sources import schemas as S


def _number(value: Column, kind: str = "long") -> Column:
    """A number where the text is one, else missing."""
    return value.try_cast(kind)


def _filled(*names: Column) -> Column:
    """The first alternative that is neither missing nor empty."""
    return F.coalesce(*[F.when(n != "", n) for n in names])


def result_set(payloads: DataFrame, column: str, index: int, types: dict[str, str]) -> DataFrame:
    """Rows of one headers/rowSet table; columns are found by header name."""
    parsed = payloads.withColumn("_p", F.from_json(column, S.RESULT_SETS)).select(
        *[c for c in payloads.columns if c != column], F.get("_p.resultSets", F.lit(index)).alias("_set")
    )
    rows = parsed.select(*[c for c in parsed.columns if c != "_set"], "_set.headers", F.explode("_set.rowSet").alias("_row"))
    place = lambda name: F.array_position("headers", name).cast("int")
    value = lambda name: F.when(place(name) > 0, F.get("_row", place(name) - 1))
    fields = [value(name).try_cast(kind).alias(name) for name, kind in types.items()]
    return rows.select(*[c for c in rows.columns if c not in ("headers", "_row")], *fields)


def _board_row(game: Column) -> list[Column]:
    return [
        _filled(game["gameId"], game["gameIdStr"], game["GAME_ID"]).alias("game_id"),
        _number(_filled(game["homeTeam"]["teamId"], game["homeTeamId"])).alias("home_team_id"),
        _number(_filled(game["awayTeam"]["teamId"], game["awayTeamId"], game["visitorTeamId"])).alias("away_team_id"),
        F.coalesce(_filled(game["gameStatusText"], game["status"], game["gameStatus"]), F.lit("Scheduled")).alias("game_status"),
    ]


def scoreboard(payloads: DataFrame, column: str, day: str | Column | None = None) -> DataFrame:
    """Games of a scoreboard; a board of another day is ignored."""
    parsed = payloads.select(F.from_json(column, S.SCOREBOARD).alias("_p")).select("_p.scoreboard.*")
    board_day = F.col("gameDate")
    if day is not None:
        wanted = F.lit(day) if isinstance(day, str) else day
        parsed = parsed.filter(board_day.isNull() | (board_day == "") | (board_day == wanted))
    return parsed.select(_number(board_day, "date").alias("board_date"), F.explode("games").alias("_g")).select(
        "board_date", *_board_row(F.col("_g"))
    )


def season_schedule(payloads: DataFrame, column: str, day_prefix: str | None = None) -> DataFrame:
    """Games of a season schedule, optionally of the days with a date prefix."""
    games = (
        payloads.select(F.from_json(column, S.SEASON_SCHEDULE).alias("_p"))
        .select(F.explode("_p.leagueSchedule.gameDates").alias("_day"))
        .select(F.explode("_day.games").alias("_g"))
    )
    if day_prefix is not None:
        games = games.filter(F.startswith(F.col("_g.gameDateEst"), F.lit(day_prefix)))
    day = _number(F.substring("_g.gameDateEst", 1, 10), "date")
    return games.select(day.alias("game_date"), *_board_row(F.col("_g")))


def live_standings(rows: DataFrame) -> DataFrame:
    """Typed standings; a streak is text like 'W 5' and anything else is 0."""
    parts = F.split(F.trim("strCurrentStreak"), r"\s+")
    length = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))
    rank = _number(F.col("PlayoffRank"), "int")
    return rows.select(
        _number(F.col("TeamID")).alias("team_id"),
        _number(F.col("WINS"), "int").alias("wins"),
        _number(F.col("LOSSES"), "int").alias("losses"),
        _number(F.col("WinPCT"), "double").alias("win_pct"),
        rank.alias("conf_rank"),
        F.coalesce(_number(F.col("LeagueRank"), "int"), rank).alias("league_rank"),
        F.coalesce(_number(F.col("ConferenceGamesBack"), "double"), F.lit(0.0)).alias("games_back"),
        F.coalesce(F.when(F.get(parts, F.lit(0)) == "W", length).otherwise(-length), F.lit(0)).alias("streak"),
    )


def manual_games(payloads: DataFrame, column: str, today: Column | None = None) -> DataFrame:
    """Games given by hand as a JSON array; short id names are accepted."""
    games = payloads.select(F.explode(F.from_json(column, f"array<{S.MANUAL_GAME.simpleString()}>")).alias("_g")).select("_g.*")
    return games.select(
        "game_id",
        _number(F.coalesce("home_team_id", "home_id")).alias("home_team_id"),
        _number(F.coalesce("away_team_id", "away_id")).alias("away_team_id"),
        F.coalesce("game_status", F.lit("Scheduled")).alias("game_status"),
        F.coalesce(_number(F.col("game_date"), "date"), today if today is not None else F.current_date()).alias("game_date"),
    )
