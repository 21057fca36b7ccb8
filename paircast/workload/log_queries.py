"""Scans, row-wise features and joins on the contest log."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.functions.boxscore import fatigue_score, win_flag
from paircast.operators import games as G
from paircast.operators.form import form_features, latest_features
from paircast.operators.preparation import keep_last
from paircast.plans.contest_table import narrow_log
from paircast.workload import tables as T
from paircast.workload.registry import i8, query, r6, tidy

BOX = (
    "game_id", "game_date", "season", "team_id", "team_abbr", "team_name", "matchup", "wl",
    "pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov",
)
RATES = ("fg_pct", "fg3_pct", "ft_pct", "plus_minus")
BOX_SQL = ", ".join(
    c if c in ("game_date", "season", "team_abbr", "team_name", "matchup", "wl") else i8(c) for c in BOX
)


@query("scan_games", f"WITH {T.LOG_SQL} SELECT {BOX_SQL}, {', '.join(r6(c) for c in RATES)} FROM log")
def scan_games(spark, sf_dir):
    return tidy(T.game_log(spark, sf_dir), *BOX, *RATES)


SEASON = "1996-97"


@query("scan_season", f"WITH {T.LOG_SQL} SELECT {i8('game_id')}, game_date, season, {i8('team_id')}, wl, {i8('pts')} FROM log WHERE season = '{SEASON}'")
def scan_season(spark, sf_dir):
    return tidy(T.season_log(spark, sf_dir, season=SEASON), "game_id", "game_date", "season", "team_id", "wl", "pts")


@query("season_filter", f"WITH {T.LOG_SQL} SELECT season, count(*) AS n, {i8('sum(pts)', 'pts')} FROM log WHERE season <> '{SEASON}' GROUP BY season")
def season_filter(spark, sf_dir):
    rest = T.season_log(spark, sf_dir, exclude=SEASON)
    return tidy(rest.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("pts").alias("pts")))


DAY = "1997-03-15"


@query("scan_by_date", f"WITH {T.LOG_SQL} SELECT {i8('game_id')}, game_date, {i8('team_id')}, matchup, wl FROM log WHERE game_date = DATE '{DAY}'")
def scan_by_date(spark, sf_dir):
    return tidy(T.season_log(spark, sf_dir, since=DAY, until=DAY), "game_id", "game_date", "team_id", "matchup", "wl")


@query("ingest_seasons", f"WITH {T.LOG_SQL} SELECT season, count(*) AS n, count(DISTINCT game_id) AS games, min(game_date) AS first_day, max(game_date) AS last_day FROM log GROUP BY season")
def ingest_seasons(spark, sf_dir):
    tagged = G.with_season(T.game_log(spark, sf_dir).drop("season"))
    return tidy(
        tagged.groupBy("season").agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("game_id").alias("games"),
            F.min("game_date").alias("first_day"),
            F.max("game_date").alias("last_day"),
        )
    )


@query("dim_team", f"WITH {T.TEAMS_SQL} SELECT id, full_name, nickname FROM teams")
def dim_team(spark, sf_dir):
    return tidy(T.teams(spark, sf_dir))


KEYS = ("game_id", "team_id")
KEYS_SQL = f"{i8('game_id')}, {i8('team_id')}"
_dz = lambda e: f"(CASE WHEN {e} = 0 THEN 1.0 ELSE {e} END)"
RATIO_SQL = {
    "efg_pct": f"(fgm + CAST(0.5 AS DOUBLE) * fg3m) / {_dz('fga')}",
    "tov_pct": f"tov / {_dz('(fga + CAST(0.44 AS DOUBLE) * fta + tov)')}",
    "oreb_pct": f"oreb / {_dz('(oreb + dreb)')}",
    "ft_rate": f"fta / {_dz('fga')}",
    "ts_pct": f"pts / {_dz('(2 * (fga + CAST(0.44 AS DOUBLE) * fta))')}",
    "pace": "fga + CAST(0.44 AS DOUBLE) * fta - oreb + tov",
    "ast_to_ratio": f"ast / {_dz('tov')}",
    "reb_diff": "reb - (oreb + dreb)",
    "fg3a_rate": f"fg3a / {_dz('fga')}",
}
FACTORS = ("efg_pct", "tov_pct", "oreb_pct", "ft_rate", "ts_pct")
ADVANCED = ("pace", "ast_to_ratio", "reb_diff", "fg3a_rate")
RATIOS_SQL = f"{T.LOG_SQL},\nrich AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RATIO_SQL.items())} FROM log)"


@query("four_factors", f"WITH {RATIOS_SQL} SELECT {KEYS_SQL}, {', '.join(r6(c) for c in FACTORS)} FROM rich")
def four_factors(spark, sf_dir):
    return tidy(G.four_factors(T.game_log(spark, sf_dir)), *KEYS, *FACTORS)


@query("advanced_metrics", f"WITH {RATIOS_SQL} SELECT {KEYS_SQL}, {r6('pace')}, {r6('ast_to_ratio')}, {i8('reb_diff')}, {r6('fg3a_rate')} FROM rich")
def advanced_metrics(spark, sf_dir):
    return tidy(G.advanced_metrics(T.game_log(spark, sf_dir)), *KEYS, *ADVANCED)


@query("home_away", f"WITH {T.LOG_SQL} SELECT {KEYS_SQL}, {i8('CASE WHEN at_home THEN 1 ELSE 0 END', 'is_home')}, {i8('CASE WHEN at_home THEN 0 ELSE 1 END', 'is_away')} FROM log")
def home_away(spark, sf_dir):
    return tidy(G.with_side_flags(T.game_log(spark, sf_dir)), *KEYS, "is_home", "is_away")


@query("win_flag", f"WITH {T.LOG_SQL} SELECT {KEYS_SQL}, CAST(CASE WHEN wl = 'W' THEN 1 ELSE 0 END AS BIGINT) AS won FROM log")
def win_flags(spark, sf_dir):
    return tidy(T.game_log(spark, sf_dir).withColumn("won", win_flag(F.col("wl"))), *KEYS, "won")


@query("valid_games", f"WITH {T.CONTESTS_SQL} SELECT {i8('game_id')}, game_date, season, {i8('home_team_id')}, {i8('away_team_id')}, home_wl, {r6('home_plus_minus')} FROM contests")
def valid_games(spark, sf_dir):
    return tidy(
        G.valid_contests(T.game_log(spark, sf_dir)),
        "game_id", "game_date", "season", "home_team_id", "away_team_id", "home_wl", "home_plus_minus",
    )


@query("season_of_date", f"SELECT {i8('o_orderkey', 'game_id')}, {T.season_sql('o_orderdate')} AS season FROM orders")
def season_of_date(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"))
    return tidy(G.with_season(orders), "game_id", "season")


_SCHEDULE_COLUMNS = f"{i8('game_id')}, {i8('home_team_id')}, {i8('away_team_id')}"


@query("regular_games", f"WITH {T.SCHEDULE_SQL}, {T.TEAMS_SQL} SELECT {_SCHEDULE_COLUMNS} FROM schedule WHERE home_team_id IN (SELECT id FROM teams) AND away_team_id IN (SELECT id FROM teams)")
def regular_games(spark, sf_dir):
    regular, _ = G.split_exhibition(T.schedule(spark, sf_dir), T.teams(spark, sf_dir))
    return tidy(regular, "game_id", "home_team_id", "away_team_id")


@query(
    "skipped_games",
    f"""WITH {T.SCHEDULE_SQL}, {T.TEAMS_SQL}
    SELECT {i8('s.game_id', 'game_id')}, coalesce(h.full_name, 'Team #' || CAST(s.home_team_id AS VARCHAR)) AS home_name,
           coalesce(a.full_name, 'Team #' || CAST(s.away_team_id AS VARCHAR)) AS away_name
    FROM schedule s LEFT JOIN teams h ON h.id = s.home_team_id LEFT JOIN teams a ON a.id = s.away_team_id
    WHERE h.id IS NULL OR a.id IS NULL""",
)
def skipped_games(spark, sf_dir):
    _, skipped = G.split_exhibition(T.schedule(spark, sf_dir), T.teams(spark, sf_dir))
    return tidy(skipped, "game_id", "home_name", "away_name")


@query(
    "game_results",
    f"""WITH {T.CONTESTS_SQL}, {T.TEAMS_SQL}, named AS (
      SELECT c.game_id, c.game_date, coalesce(h.full_name, c.home_team) AS home_team,
             coalesce(a.full_name, c.away_team) AS away_team, home_wl
      FROM contests c LEFT JOIN teams h ON h.id = c.home_team_id LEFT JOIN teams a ON a.id = c.away_team_id)
    SELECT {i8('game_id')}, game_date, home_team, away_team, CASE WHEN home_wl = 'W' THEN home_team ELSE away_team END AS winner FROM named""",
)
def game_results(spark, sf_dir):
    return tidy(G.game_results(T.game_log(spark, sf_dir), T.teams(spark, sf_dir)), "game_id", "game_date", "home_team", "away_team", "winner")


@query("team_abbr", f"WITH {T.LOG_SQL} SELECT {i8('team_id')}, arg_min(team_abbr, (game_date, game_id)) AS team_abbr FROM log GROUP BY team_id")
def team_abbr(spark, sf_dir):
    return tidy(G.team_abbreviations(T.game_log(spark, sf_dir)), "team_id", "team_abbr")


@query(
    "log_profile",
    f"""WITH {T.LOG_SQL} SELECT count(*) AS n, count(DISTINCT game_date) AS days, count(DISTINCT team_id) AS teams,
    count(DISTINCT game_id) AS games, count(DISTINCT season) AS seasons, max(game_date) AS last_day FROM log""",
)
def log_profile(spark, sf_dir):
    log = T.game_log(spark, sf_dir)
    return tidy(
        log.agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("game_date").alias("days"),
            F.countDistinct("team_id").alias("teams"),
            F.countDistinct("game_id").alias("games"),
            F.countDistinct("season").alias("seasons"),
            F.max("game_date").alias("last_day"),
        )
    )


@query(
    "dedupe_last",
    f"""SELECT {i8('l_orderkey')}, l_linestatus, {i8('l_linenumber')}, {i8('l_partkey')}
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus
          ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1""",
)
def dedupe_last(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    kept = keep_last(rows, ["l_orderkey", "l_linestatus"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    return tidy(kept, "l_orderkey", "l_linestatus", "l_linenumber", "l_partkey")


@query(
    "dedupe_first",
    f"""SELECT {i8('l_orderkey')}, l_linestatus, {i8('l_linenumber')}, {i8('l_partkey')}
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus
          ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1""",
)
def dedupe_first(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    kept = G.first_per_key(rows, ["l_orderkey", "l_linestatus"], order)
    return tidy(kept, "l_orderkey", "l_linestatus", "l_linenumber", "l_partkey")


# --- form ------------------------------------------------------------------

SEQ_SQL = f"""{RATIOS_SQL},
seq AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS rn,
               CASE WHEN wl = 'W' THEN 1 ELSE 0 END AS won,
               CAST(game_date - lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS BIGINT) AS gap
        FROM rich)"""
from paircast.constants import ROLLED_STATS  # noqa: E402

_ORDER = "PARTITION BY team_id ORDER BY rn"
_past = lambda n: f"({_ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
MEAN_SQL = {f"{s}_roll_mean": f"CASE WHEN count({s}) OVER {_past(20)} >= 5 THEN avg({s}) OVER {_past(20)} END" for s in ROLLED_STATS}
STD_SQL = {f"{s}_roll_std": f"CASE WHEN count({s}) OVER {_past(20)} >= 5 THEN stddev_samp({s}) OVER {_past(20)} END" for s in ROLLED_STATS}
MOMENTUM_SQL = {
    "win_streak": f"CAST(sum(won) OVER {_past(5)} AS DOUBLE)",
    "recent_form": f"avg(won) OVER {_past(5)}",
    "win_pattern_3game": f"""CASE WHEN rn = 1 THEN NULL WHEN rn = 2 THEN CAST(3.5 AS DOUBLE) ELSE CAST(
        4 * coalesce(lag(won, 3) OVER ({_ORDER}), 0) + 2 * lag(won, 2) OVER ({_ORDER}) + lag(won, 1) OVER ({_ORDER}) AS DOUBLE) END""",
    "momentum_trend": f"avg(won) OVER {_past(3)} - avg(won) OVER {_past(10)}",
    "win_consistency": f"1 - coalesce(CASE WHEN count(won) OVER {_past(10)} >= 3 THEN stddev_samp(won) OVER {_past(10)} END, 0.5)",
    "is_home": "CASE WHEN at_home THEN 1 ELSE 0 END",
    "days_rest": "CAST(greatest(least(coalesce(gap, 3), 10), 0) AS DOUBLE)",
    "is_back_to_back": "CASE WHEN greatest(least(coalesce(gap, 3), 10), 0) = 1 THEN 1 ELSE 0 END",
    "is_3_in_4": f"CASE WHEN sum(gap) OVER ({_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= 4 THEN 1 ELSE 0 END",
}
FLAGS = ("is_home", "is_back_to_back", "is_3_in_4")


def form_select(columns: dict) -> str:
    return f"WITH {SEQ_SQL} SELECT {KEYS_SQL}, {', '.join(i8(e, n) if n in FLAGS else r6(e, n) for n, e in columns.items())} FROM seq"


def _form(spark, sf_dir, *columns, **parts):
    wanted = dict(rolling=False, ewm=False, momentum=False) | parts
    return tidy(form_features(narrow_log(T.form_log(spark, sf_dir)), derive=G.with_ratios, **wanted), *KEYS, *columns)


@query("rolling_mean", form_select(MEAN_SQL))
def rolling_mean(spark, sf_dir):
    return _form(spark, sf_dir, *MEAN_SQL, rolling=True)


@query("rolling_std", form_select(STD_SQL))
def rolling_std(spark, sf_dir):
    return _form(spark, sf_dir, *STD_SQL, rolling=True)


EWM = [f"{s}_ewm" for s in ROLLED_STATS]
_ewm_sum = lambda s: (
    f"CASE WHEN count(p.{s}) >= 5 THEN sum(p.{s} * pow(9.0 / 11.0, c.rn - p.rn)) / "
    f"sum(CASE WHEN p.{s} IS NOT NULL THEN pow(9.0 / 11.0, c.rn - p.rn) END) END"
)


@query(
    "ewm_mean",
    f"""WITH {SEQ_SQL} SELECT {i8('c.game_id', 'game_id')}, {i8('c.team_id', 'team_id')},
    {', '.join(r6(_ewm_sum(s), f'{s}_ewm') for s in ROLLED_STATS)}
    FROM seq c LEFT JOIN seq p ON p.team_id = c.team_id AND p.rn BETWEEN c.rn - 250 AND c.rn - 1
    GROUP BY c.game_id, c.team_id""",
)
def ewm_mean(spark, sf_dir):
    return _form(spark, sf_dir, *EWM, ewm=True)


def _momentum_query(name: str, column: str):
    @query(name, form_select({column: MOMENTUM_SQL[column]}))
    def run(spark, sf_dir):
        return _form(spark, sf_dir, column, momentum=True)

    return run


for _name, _column in {
    "win_streak5": "win_streak",
    "recent_form": "recent_form",
    "win_pattern3": "win_pattern_3game",
    "momentum_trend": "momentum_trend",
    "win_consistency": "win_consistency",
    "days_rest": "days_rest",
    "back_to_back": "is_back_to_back",
    "three_in_four": "is_3_in_4",
}.items():
    _momentum_query(_name, _column)


@query(
    "fatigue_score",
    f"""WITH {SEQ_SQL}, f AS (SELECT game_id, team_id, {', '.join(f'{MOMENTUM_SQL[c]} AS {c}' for c in ('days_rest', 'is_back_to_back', 'is_3_in_4'))} FROM seq)
    SELECT {KEYS_SQL}, {r6("least(CASE WHEN days_rest = 0 THEN 0.4 WHEN days_rest = 1 THEN 0.2 ELSE 0 END + 0.3 * is_back_to_back + 0.3 * is_3_in_4, 1)", "fatigue")} FROM f""",
)
def fatigue(spark, sf_dir):
    log = form_features(T.stored_log(spark, sf_dir), rolling=False, ewm=False)
    score = fatigue_score(F.col("days_rest"), F.col("is_back_to_back"), F.col("is_3_in_4"))
    return tidy(log.withColumn("fatigue", score), *KEYS, "fatigue")


FORM_SQL = f"""{SEQ_SQL},
form AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in {**MEAN_SQL, **STD_SQL, **MOMENTUM_SQL}.items())} FROM seq)"""
_READY = " AND ".join(f"{c} IS NOT NULL" for c in (*MEAN_SQL, *STD_SQL, "win_streak"))


@query("drop_unready", f"WITH {FORM_SQL} SELECT {KEYS_SQL}, {r6('pts_roll_mean')}, {r6('win_streak')} FROM form WHERE {_READY}")
def drop_unready(spark, sf_dir):
    features = form_features(narrow_log(T.form_log(spark, sf_dir)), ewm=False, derive=G.with_ratios)
    return tidy(G.ready_rows(features), *KEYS, "pts_roll_mean", "win_streak")


_LATEST = ("pts_roll_mean", "efg_pct_roll_mean", "pace_roll_std", "win_streak", "recent_form", "days_rest", "is_home")


@query(
    "latest_features",
    f"""WITH {FORM_SQL}, newest AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY rn DESC) AS k FROM form)
    SELECT {KEYS_SQL}, {', '.join(i8(c) if c in FLAGS else r6(c) for c in _LATEST)} FROM newest WHERE k = 1""",
)
def latest(spark, sf_dir):
    features = form_features(narrow_log(T.form_log(spark, sf_dir)), ewm=False, derive=G.with_ratios)
    return tidy(latest_features(features), *KEYS, *_LATEST)
