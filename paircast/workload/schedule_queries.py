"""JSON payloads, boards, result sources and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.constants import ROLLED_STATS
from paircast.operators import games as G
from paircast.operators import history as H
from paircast.operators.form import form_features
from paircast.operators.schedule import all_finished, scoreboard_status
from paircast.plans.contest_table import matched_sides, narrow_log
from paircast.session import scratch_path, stored
from paircast.sources import payloads as J
from paircast.sources.files import write_by_season
from paircast.streaming import incremental as I
from paircast.workload import tables as T
from paircast.workload.history_queries import RESULTS_SQL, _results
from paircast.workload.log_queries import FLAGS, FORM_SQL, MEAN_SQL, MOMENTUM_SQL, SEASON, STD_SQL, _READY, _ewm_sum
from paircast.workload.registry import i8, query, r6, tidy

# --- payloads: landed JSON, in pages of at most 100 games -------------------

_STATUS = "CASE game_id % 4 WHEN 0 THEN 'Final' WHEN 1 THEN 'FINAL/OT' WHEN 2 THEN '7:30 pm ET' END"


def _status():
    kind = F.col("game_id") % 4
    return F.when(kind == 0, "Final").when(kind == 1, "FINAL/OT").when(kind == 2, "7:30 pm ET")


def _orders(spark, sf_dir):
    return T.contest_sides(spark, sf_dir).select("game_id", "game_date", "home_team_id", "away_team_id")


def _page(game: str = "game_id"):
    return F.floor(F.col(game) / 100)


@query("json_resultset", f"SELECT {i8('l_orderkey', 'ORDER_ID')}, {i8('l_partkey', 'PART_ID')}, {r6('l_quantity', 'QTY')} FROM lineitem")
def json_resultset(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    rows = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.array(text("l_orderkey"), text("l_quantity"), text("l_partkey"))).alias("rowSet")
    )
    headers = F.array(F.lit("ORDER_ID"), F.lit("QTY"), F.lit("PART_ID")).alias("headers")
    payloads = rows.select(F.to_json(F.struct(F.array(F.struct(headers, "rowSet")).alias("resultSets"))).alias("payload"))
    return tidy(J.result_set(payloads, "payload", 0, {"ORDER_ID": "long", "PART_ID": "long", "QTY": "double"}))


def _board_game():
    """Alternative spellings of the same fields, as sources use them."""
    text = lambda c: F.col(c).cast("string")
    even = F.col("game_id") % 2 == 0
    return F.struct(
        F.when(even, text("game_id")).alias("gameId"),
        F.when(~even, text("game_id")).alias("GAME_ID"),
        F.when(even, F.struct(text("home_team_id").alias("teamId"))).alias("homeTeam"),
        F.when(~even, text("home_team_id")).alias("homeTeamId"),
        F.when(even, text("away_team_id")).otherwise("TBD").alias("visitorTeamId"),
        F.when(even, _status()).alias("gameStatusText"),
        F.when(~even, _status()).alias("status"),
        F.concat(text("game_date"), F.lit("T00:00:00Z")).alias("gameDateEst"),
    )


_BOARD_SQL = f"""{T.LOG_SQL}, board AS (SELECT DISTINCT game_id, game_date, home_team_id, CASE WHEN game_id % 2 = 0 THEN away_team_id END AS away_team_id, coalesce({_STATUS}, 'Scheduled') AS game_status FROM raw)"""


@query("json_scoreboard", f"WITH {_BOARD_SQL} SELECT game_date AS board_date, CAST(game_id AS VARCHAR) AS game_id, {i8('home_team_id')}, {i8('away_team_id')}, game_status FROM board")
def json_scoreboard(spark, sf_dir):
    pages = _orders(spark, sf_dir).groupBy("game_date", _page().alias("page")).agg(F.collect_list(_board_game()).alias("games"))
    board = F.struct(F.col("game_date").cast("string").alias("gameDate"), "games")
    payloads = pages.select(F.to_json(F.struct(board.alias("scoreboard"))).alias("payload"))
    return tidy(J.scoreboard(payloads, "payload"))


@query("json_schedule", f"WITH {_BOARD_SQL} SELECT game_date, CAST(game_id AS VARCHAR) AS game_id, {i8('home_team_id')}, {i8('CASE WHEN game_id % 2 = 0 THEN NULL END', 'away_team_id')}, game_status FROM board WHERE year(game_date) = 1997")
def json_schedule(spark, sf_dir):
    game = _board_game().withField("visitorTeamId", F.lit(None).cast("string"))
    pages = _orders(spark, sf_dir).groupBy("game_date", _page().alias("page")).agg(F.collect_list(game).alias("games"))
    league = F.struct(F.array(F.struct("games")).alias("gameDates"))
    payloads = pages.select(F.to_json(F.struct(league.alias("leagueSchedule"))).alias("payload"))
    return tidy(J.season_schedule(payloads, "payload", "1997"))


@query(
    "live_standings",
    f"""SELECT {i8('c_custkey', 'team_id')}, {i8('c_custkey % 60', 'wins')}, {i8('c_nationkey', 'losses')}, {r6('c_custkey % 60 / 82', 'win_pct')},
    {i8('c_custkey % 15 + 1', 'conf_rank')}, {i8('CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 15 + 1 ELSE c_custkey % 30 + 1 END', 'league_rank')},
    {r6('CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 20 / 2 END', 'games_back')},
    {i8("CASE c_custkey % 4 WHEN 0 THEN c_custkey % 9 WHEN 1 THEN -(c_custkey % 9) ELSE 0 END", 'streak')} FROM customer""",
)
def live_standings(spark, sf_dir):
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    run = F.when(key % 4 == 0, F.concat(F.lit("W "), text(key % 9))).when(key % 4 == 1, F.concat(F.lit("L "), text(key % 9))).when(key % 4 == 2, "W")
    rows = T.table(spark, sf_dir, "customer").select(
        text(key).alias("TeamID"), text(key % 60).alias("WINS"), text(F.col("c_nationkey")).alias("LOSSES"), text(key % 60 / 82).alias("WinPCT"),
        text(key % 15 + 1).alias("PlayoffRank"), F.when(key % 4 != 0, text(key % 30 + 1)).alias("LeagueRank"),
        F.when(key % 5 != 0, text(key % 20 / 2)).alias("ConferenceGamesBack"), run.alias("strCurrentStreak"),
    )
    return tidy(J.live_standings(rows))


@query(
    "manual_games",
    f"""WITH {T.SCHEDULE_SQL} SELECT CAST(game_id AS VARCHAR) AS game_id, {i8('home_team_id')}, {i8('away_team_id')},
    CASE WHEN game_id % 3 = 0 THEN 'Final' ELSE 'Scheduled' END AS game_status, game_date FROM schedule""",
)
def manual_games(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    long_names = F.col("game_id") % 2 == 0
    game = F.struct(
        text("game_id").alias("game_id"),
        F.when(long_names, text("home_team_id")).alias("home_team_id"),
        F.when(~long_names, text("home_team_id")).alias("home_id"),
        F.when(long_names, text("away_team_id")).alias("away_team_id"),
        F.when(~long_names, text("away_team_id")).alias("away_id"),
        F.when(F.col("game_id") % 3 == 0, "Final").alias("game_status"),
        text("game_date").alias("game_date"),
    )
    payloads = T.schedule(spark, sf_dir).select(F.to_json(F.array(game)).alias("payload"))
    return tidy(J.manual_games(payloads, "payload"))


# --- boards -----------------------------------------------------------------


def _board(spark, sf_dir):
    return _orders(spark, sf_dir).withColumn("game_status", _status())


_DAY_BOARD_SQL = f"{T.LOG_SQL}, board AS (SELECT DISTINCT game_id, game_date, home_team_id, away_team_id, {_STATUS} AS game_status FROM raw)"


@query(
    "scoreboard_status",
    f"""WITH {_DAY_BOARD_SQL} SELECT game_date, count(*) AS n_games, bool_and(coalesce(contains(lower(game_status), 'final'), false)) AS all_final,
    bool_or(coalesce(contains(lower(game_status), 'final'), false)) AS any_final, count(*) FILTER (WHERE game_status IS NULL) AS n_missing,
    count(*) FILTER (WHERE game_status = 'Final') AS n_final FROM board GROUP BY game_date""",
)
def board_status(spark, sf_dir):
    status = scoreboard_status(_board(spark, sf_dir))
    of = lambda key: F.coalesce(F.try_element_at("status_counts", F.lit(key)), F.lit(0))
    return tidy(status.withColumn("n_missing", of("None")).withColumn("n_final", of("Final")).drop("status_counts"))


@query("all_finished", f"WITH {_DAY_BOARD_SQL} SELECT game_date, bool_and(coalesce(game_status = 'Final', false)) AS all_finished FROM board GROUP BY game_date")
def finished_days(spark, sf_dir):
    return tidy(all_finished(_board(spark, sf_dir)))


_NAMES = "coalesce({p}.nickname, CAST(b.{k} AS VARCHAR))"


@query(
    "schedule_names",
    f"""WITH {_DAY_BOARD_SQL}, {T.TEAMS_SQL} SELECT {i8('b.game_id', 'game_id')}, {_NAMES.format(p='h', k='home_team_id')} AS home_team,
    {_NAMES.format(p='a', k='away_team_id')} AS away_team FROM board b LEFT JOIN teams h ON h.id = b.home_team_id LEFT JOIN teams a ON a.id = b.away_team_id""",
)
def schedule_names(spark, sf_dir):
    return tidy(G.with_team_names(_orders(spark, sf_dir), T.teams(spark, sf_dir), "nickname"), "game_id", "home_team", "away_team")


# A live board exists for every third game; every ninth one is of another day.
_LIVE = "CASE WHEN game_id % 3 = 0 AND game_id % 9 <> 0 THEN 'Q' || CAST(game_id % 4 + 1 AS VARCHAR) ELSE game_status END"


def live_board(board):
    day = F.when(F.col("game_id") % 9 == 0, F.date_add("game_date", 1)).otherwise(F.col("game_date"))
    text = F.concat(F.lit("Q"), (F.col("game_id") % 4 + 1).cast("string"))
    return board.filter("game_id % 3 = 0").select("game_id", day.alias("board_date"), text.alias("live_status"))


@query("status_overlay", f"WITH {_DAY_BOARD_SQL} SELECT {i8('game_id')}, game_date, {_LIVE} AS game_status FROM board")
def status_overlay(spark, sf_dir):
    board = _board(spark, sf_dir)
    return tidy(G.overlay_status(board, live_board(board)), "game_id", "game_date", "game_status")


# Every fifth game of the board lacks an id; board keys carry leading zeros.
@query(
    "repair_team_ids",
    f"""WITH {_DAY_BOARD_SQL}, sides AS (SELECT game_id, max(CASE WHEN at_home THEN team_id END) AS h, max(CASE WHEN NOT at_home THEN team_id END) AS a,
      count(*) AS n, min(team_id) AS only FROM log GROUP BY game_id)
    SELECT '00' || CAST(b.game_id AS VARCHAR) AS game_id,
      {i8("CASE WHEN b.game_id % 10 = 0 THEN CASE WHEN s.n = 1 THEN s.only ELSE s.h END ELSE b.home_team_id END", 'home_team_id')},
      {i8("CASE WHEN b.game_id % 5 = 0 THEN CASE WHEN s.n > 1 THEN s.a END ELSE b.away_team_id END", 'away_team_id')}
    FROM board b JOIN sides s USING (game_id)""",
)
def repair_team_ids(spark, sf_dir):
    gap = lambda n, c: F.when(F.col("game_id") % n != 0, F.col(c)).alias(c)
    board = _orders(spark, sf_dir).select(
        F.concat(F.lit("00"), F.col("game_id").cast("string")).alias("game_id"), gap(10, "home_team_id"), gap(5, "away_team_id")
    )
    return tidy(G.repair_team_ids(board, T.game_log(spark, sf_dir)), "game_id", "home_team_id", "away_team_id")


# --- results ----------------------------------------------------------------

_LINES_SQL = f"""{T.CONTESTS_SQL}, {T.TEAMS_SQL},
lined AS (SELECT c.game_id, c.game_date, coalesce(h.full_name, CAST(c.home_team_id AS VARCHAR)) AS home_team, coalesce(a.full_name, CAST(c.away_team_id AS VARCHAR)) AS away_team, c.home_pts, c.away_pts
  FROM contests c LEFT JOIN teams h ON h.id = c.home_team_id LEFT JOIN teams a ON a.id = c.away_team_id
  WHERE c.game_id % 5 <> 0 AND c.game_id % 11 <> 0 AND c.home_pts <> c.away_pts),
lines AS (SELECT game_id, game_date, home_team, away_team, CASE WHEN home_pts > away_pts THEN home_team ELSE away_team END AS winner FROM lined),
cached0 AS (SELECT c.game_id, c.game_date, coalesce(h.full_name, c.home_team) AS home_team, coalesce(a.full_name, c.away_team) AS away_team, c.home_wl
  FROM contests c LEFT JOIN teams h ON h.id = c.home_team_id LEFT JOIN teams a ON a.id = c.away_team_id),
cached AS (SELECT game_id, game_date, home_team, away_team, CASE WHEN home_wl = 'W' THEN home_team ELSE away_team END AS winner FROM cached0)"""
_RESULT = ("game_id", "game_date", "home_team", "away_team", "winner")
_RESULT_SQL = f"{i8('game_id')}, game_date, home_team, away_team, winner"


def _line_results(spark, sf_dir):
    log = T.game_log(spark, sf_dir)
    header = _orders(spark, sf_dir).withColumn("game_status", F.when(F.col("game_id") % 5 == 0, "Q3 5:00").otherwise("Final"))
    points = F.when(F.col("game_id") % 11 == 0, "n/a").otherwise(F.col("pts").cast("string"))
    lines = log.select("game_id", "team_id", points.alias("pts"), F.lit(1).alias("line_no"))
    return G.linescore_results(header, lines, T.teams(spark, sf_dir))


def _cached_results(spark, sf_dir):
    return G.game_results(T.game_log(spark, sf_dir), T.teams(spark, sf_dir))


@query("linescore_results", f"WITH {_LINES_SQL} SELECT {_RESULT_SQL} FROM lines")
def linescore_results(spark, sf_dir):
    return tidy(_line_results(spark, sf_dir), *_RESULT)


@query("results_supplement", f"WITH {_LINES_SQL} SELECT {_RESULT_SQL} FROM cached WHERE game_id % 2 = 0 UNION ALL SELECT {_RESULT_SQL} FROM lines WHERE game_id % 2 <> 0")
def results_supplement(spark, sf_dir):
    primary = _cached_results(spark, sf_dir).filter("game_id % 2 = 0")
    return tidy(G.supplement(primary, _line_results(spark, sf_dir).select(*primary.columns), ["game_id"]), *_RESULT)


@query(
    "results_fallback",
    f"""WITH {_LINES_SQL}, tagged AS (SELECT *, 1 AS source_rank FROM cached WHERE day(game_date) % 2 = 0 UNION ALL SELECT *, 2 FROM lines),
    best AS (SELECT game_date, min(source_rank) AS source_rank FROM tagged GROUP BY 1)
    SELECT {_RESULT_SQL}, {i8('source_rank')} FROM tagged JOIN best USING (game_date, source_rank)""",
)
def results_fallback(spark, sf_dir):
    cached = _cached_results(spark, sf_dir).filter(F.dayofmonth("game_date") % 2 == 0).select(*_RESULT)
    return tidy(G.lowest_priority([cached, _line_results(spark, sf_dir).select(*_RESULT)], ["game_date"]), *_RESULT, "source_rank")


@query(
    "schedule_fallback",
    f"""WITH {_DAY_BOARD_SQL}, tagged AS (
      SELECT *, 1 AS source_rank FROM board WHERE game_id % 3 = 0 AND day(game_date) % 2 = 0
      UNION ALL SELECT *, 2 FROM board WHERE game_id IN (SELECT game_id FROM raw GROUP BY 1 HAVING count(*) = 2) UNION ALL SELECT *, 3 FROM board),
    best AS (SELECT game_date, min(source_rank) AS source_rank FROM tagged GROUP BY 1)
    SELECT {i8('game_id')}, game_date, {i8('home_team_id')}, {i8('away_team_id')}, {i8('source_rank')} FROM tagged JOIN best USING (game_date, source_rank)""",
)
def schedule_fallback(spark, sf_dir):
    board = _orders(spark, sf_dir)
    live = board.filter((F.col("game_id") % 3 == 0) & (F.dayofmonth("game_date") % 2 == 0))
    logged = T.scored_contests(spark, sf_dir).select(*board.columns)
    return tidy(G.lowest_priority([live, logged, board], ["game_date"]), "game_id", "game_date", "home_team_id", "away_team_id", "source_rank")


# --- incremental upkeep ------------------------------------------------------


@query("union_log", f"WITH {T.LOG_SQL} SELECT {i8('game_id')}, {i8('team_id')}, {r6("CASE WHEN season < '1997-98' THEN plus_minus END", 'plus_minus')} FROM log")
def union_log(spark, sf_dir):
    log = T.game_log(spark, sf_dir)
    old, new = log.filter("season < '1997-98'"), log.filter("season >= '1997-98'").drop("plus_minus")
    return tidy(old.unionByName(new, allowMissingColumns=True), "game_id", "team_id", "plus_minus")


_REPLACED_SQL = f"WITH {T.LOG_SQL} SELECT {i8('game_id')}, {i8('team_id')}, season, {i8(f"CASE WHEN season = '{SEASON}' THEN pts + 1 ELSE pts END", 'pts')} FROM log WHERE season <> '{SEASON}' OR game_id % 2 = 0"
_REPLACED = ("game_id", "team_id", "season", "pts")


def _log_and_fresh(spark, sf_dir):
    log = T.game_log(spark, sf_dir)
    return log, log.filter("game_id % 2 = 0").withColumn("pts", F.col("pts") + 1)


@query("season_replace", _REPLACED_SQL)
def season_replace(spark, sf_dir):
    return tidy(I.replace_season(*_log_and_fresh(spark, sf_dir), SEASON), *_REPLACED)


@query("incr_season_refresh", _REPLACED_SQL)
def incr_season_refresh(spark, sf_dir):
    """The stored log with one season's folder overwritten."""
    log, fresh = _log_and_fresh(spark, sf_dir)
    path = scratch_path(spark, "log-by-season")
    write_by_season(log, path, replace_all=True)
    write_by_season(fresh.filter(F.col("season") == SEASON), path)
    return tidy(spark.read.schema(log.schema).parquet(path), *_REPLACED)


MARK = "1998-06-01"
# Only the first ten teams have rows after the mark.
_PARTIAL_LOG = FORM_SQL.replace("FROM rich)", f"FROM rich WHERE game_date <= DATE '{MARK}' OR team_id < 10)")
_INCR_FORM = (*MEAN_SQL, *STD_SQL, *MOMENTUM_SQL)
_INCR_EWM = tuple(f"{s}_ewm" for s in ROLLED_STATS)
_INCR_SHOWN = (*_INCR_FORM, *_INCR_EWM)
_INCR_SQL = f"""WITH {_PARTIAL_LOG},
means AS (SELECT c.game_id, c.team_id, {', '.join(f'{_ewm_sum(s)} AS {s}_ewm' for s in ROLLED_STATS)}
  FROM seq c LEFT JOIN seq p ON p.team_id = c.team_id AND p.rn BETWEEN c.rn - 250 AND c.rn - 1 GROUP BY c.game_id, c.team_id)
SELECT {i8('game_id')}, {i8('team_id')}, {', '.join((i8 if c in FLAGS else r6)(c) for c in _INCR_SHOWN)} FROM form JOIN means USING (game_id, team_id)"""


def _partial_log(spark, sf_dir):
    """The log with all rows, and its rows up to the mark with the features and the state that an earlier run left."""
    log = stored(T.game_log(spark, sf_dir).filter(f"game_date <= date'{MARK}' or team_id < 10"), "game-log")
    past = log.filter(f"game_date <= date'{MARK}'")
    tails, carries = I.feature_state(past)
    return log, form_features(past, derive=G.with_ratios), (stored(tails, "tails"), stored(carries, "carries"))


def refreshed(spark, sf_dir):
    """Features up to the mark from an earlier run, and those of later rows from its state."""
    log, old, state = _partial_log(spark, sf_dir)
    return I.extend_features(stored(old, "features"), state, log, MARK)[0]


def refreshed_in_place(spark, sf_dir):
    """The same as a table by season, where only seasons with rows after the mark are overwritten."""
    log, old, state = _partial_log(spark, sf_dir)
    path = scratch_path(spark, "features-by-season")
    write_by_season(old, path, replace_all=True)
    cached = spark.read.schema(old.schema).parquet(path)
    changed = I.after(log, MARK).select("season").distinct()
    # The slice is read from the table that it overwrites, so it is stored first.
    part = cached.join(changed, "season", "left_semi")
    write_by_season(stored(I.extend_features(part, state, log, MARK)[0].select(*old.columns), "slice"), path)
    return spark.read.schema(old.schema).parquet(path)


@query("feature_refresh", _INCR_SQL)
def feature_refresh(spark, sf_dir):
    return tidy(refreshed(spark, sf_dir), "game_id", "team_id", *_INCR_SHOWN)


@query("incr_features", _INCR_SQL)
def incr_features(spark, sf_dir):
    return tidy(refreshed_in_place(spark, sf_dir), "game_id", "team_id", *_INCR_SHOWN)


@query(
    "incr_matchups",
    f"""WITH {FORM_SQL}, ready AS (SELECT * FROM form WHERE {_READY})
    SELECT {i8('h.game_id', 'game_id')}, h.game_date, {r6('h.pts_roll_mean', 'home_pts_roll_mean')}, {r6('a.win_streak', 'away_win_streak')}
    FROM ready h JOIN ready a ON h.game_id = a.game_id AND h.at_home AND NOT a.at_home""",
)
def incr_matchups(spark, sf_dir):
    features = form_features(narrow_log(T.form_log(spark, sf_dir)), ewm=False, derive=G.with_ratios)
    # The cache also holds some contests after the mark, which come again.
    cached = matched_sides(features.filter(f"game_date <= date'{MARK}' or game_id % 7 = 0"))
    return tidy(I.refresh_contests(cached, features, MARK), "game_id", "game_date", "home_pts_roll_mean", "away_win_streak")


@query(
    "incr_backfill",
    f"""WITH {RESULTS_SQL} SELECT h.date, {i8('h.game_id', 'game_id')}, CASE WHEN h.date = DATE '1998-01-10' THEN r.winner ELSE h.winner END AS winner
    FROM history h LEFT JOIN results r ON r.date = h.date AND r.away_team = h.away_team AND r.home_team = h.home_team""",
)
def incr_backfill(spark, sf_dir):
    history, results = T.history(spark, sf_dir), _results(spark, sf_dir)
    day = history.filter("date = date'1998-01-10'").select("date").distinct()
    once = H.backfill(history, results, day)
    return tidy(H.backfill(once, results, day), "date", "game_id", "winner")
