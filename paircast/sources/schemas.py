"""Explicit schemas, so that no reader has to infer one."""

from __future__ import annotations

from pyspark.sql import types as T

_COUNTS = ("pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov")

GAME_LOG = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("game_date", T.DateType()),
        T.StructField("season", T.StringType()),
        T.StructField("team_id", T.LongType()),
        T.StructField("team_abbr", T.StringType()),
        T.StructField("team_name", T.StringType()),
        T.StructField("matchup", T.StringType()),
        T.StructField("wl", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in _COUNTS],
        *[T.StructField(c, T.DoubleType()) for c in ("fg_pct", "fg3_pct", "ft_pct", "plus_minus")],
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("winner", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("home_win_prob", T.DoubleType()),
        T.StructField("model_agreement", T.DoubleType()),
        T.StructField("tier", T.StringType()),
        T.StructField("correct", T.IntegerType()),
    ]
)

_OUTCOME = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
_MARKET = T.StructType([T.StructField("key", T.StringType()), T.StructField("outcomes", T.ArrayType(_OUTCOME))])
_BOOKMAKER = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("markets", T.ArrayType(_MARKET)),
    ]
)
ODDS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sport_key", T.StringType()),
        T.StructField("sport_title", T.StringType()),
        T.StructField("commence_time", T.StringType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("bookmakers", T.ArrayType(_BOOKMAKER)),
    ]
)
ODDS_SNAPSHOT = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("data", T.ArrayType(ODDS))])

# Ids may come as numbers or as text, so they are read as text.
_TEAM_REF = T.StructType([T.StructField("teamId", T.StringType())])
BOARD_GAME = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("gameId", "gameIdStr", "GAME_ID", "homeTeamId", "awayTeamId", "visitorTeamId")]
    + [T.StructField("homeTeam", _TEAM_REF), T.StructField("awayTeam", _TEAM_REF)]
    + [T.StructField(c, T.StringType()) for c in ("gameStatusText", "status", "gameStatus", "gameDateEst")]
)
SCOREBOARD = T.StructType(
    [
        T.StructField(
            "scoreboard",
            T.StructType([T.StructField("gameDate", T.StringType()), T.StructField("games", T.ArrayType(BOARD_GAME))]),
        )
    ]
)
SEASON_SCHEDULE = T.StructType(
    [
        T.StructField(
            "leagueSchedule",
            T.StructType(
                [T.StructField("gameDates", T.ArrayType(T.StructType([T.StructField("games", T.ArrayType(BOARD_GAME))])))]
            ),
        )
    ]
)
RESULT_SETS = T.StructType(
    [
        T.StructField(
            "resultSets",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("headers", T.ArrayType(T.StringType())),
                        T.StructField("rowSet", T.ArrayType(T.ArrayType(T.StringType()))),
                    ]
                )
            ),
        )
    ]
)
MANUAL_GAME = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("game_id", "home_team_id", "home_id", "away_team_id", "away_id", "game_status", "game_date")
    ]
)
