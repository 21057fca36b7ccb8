"""Standings, head-to-head, ratings and the wide contest table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.constants import FORM_COLUMNS, H2H_DEFAULTS, ROLLED_STATS, STANDINGS_DEFAULTS
from paircast.operators import games as G
from paircast.operators import ratings as R
from paircast.operators.h2h import h2h_asof, h2h_latest
from paircast.operators.preparation import (
    chronological_split,
    default_for,
    differentials,
    feature_columns,
    feature_vector,
    validate_frame,
    with_recency_weights,
)
from paircast.operators.standings import own_days, standings_asof, standings_at_date, with_standings
from paircast.plans.contest_table import contest_columns, contest_table, matched_sides, narrow_log, side_features
from paircast.operators.form import form_features
from paircast.session import stored
from paircast.workload import tables as T
from paircast.workload.log_queries import FORM_SQL, FLAGS, _READY
from paircast.workload.registry import i8, query, r6, tidy

# --- standings -------------------------------------------------------------

_STAND_PAST = "(PARTITION BY team_id ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
STANDINGS_SQL = f"""
decided AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS at_no FROM log WHERE wl IN ('W', 'L')),
day AS MATERIALIZED (SELECT team_id, game_date, sum(CASE WHEN wl = 'W' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN wl = 'L' THEN 1 ELSE 0 END) AS l,
               max(CASE WHEN wl = 'W' THEN at_no END) AS lw, max(CASE WHEN wl = 'L' THEN at_no END) AS ll
        FROM decided GROUP BY 1, 2),
spine AS (SELECT t.team_id, d.game_date FROM (SELECT DISTINCT team_id FROM log) t, (SELECT DISTINCT game_date FROM log) d),
rec0 AS (
  SELECT s.team_id, s.game_date, CASE WHEN s.team_id < 15 THEN 'East' ELSE 'West' END AS conf,
         coalesce(sum(w) OVER {_STAND_PAST}, 0) AS wins, coalesce(sum(l) OVER {_STAND_PAST}, 0) AS losses,
         coalesce(max(lw) OVER {_STAND_PAST}, 0) - coalesce(max(ll) OVER {_STAND_PAST}, 0) AS streak
  FROM spine s LEFT JOIN day USING (team_id, game_date)),
rec AS MATERIALIZED (SELECT *, CASE WHEN wins + losses > 0 THEN CAST(wins AS DOUBLE) / (wins + losses) ELSE CAST(0.5 AS DOUBLE) END AS win_pct FROM rec0),
standings AS MATERIALIZED (
  SELECT *, rank() OVER (PARTITION BY game_date, conf ORDER BY win_pct DESC) AS conf_rank,
         rank() OVER (PARTITION BY game_date ORDER BY win_pct DESC) AS league_rank,
         CAST((max(wins) OVER (PARTITION BY game_date, conf) - wins) + (losses - min(losses) OVER (PARTITION BY game_date, conf)) AS DOUBLE) / 2 AS games_back
  FROM rec)"""
_STAND_KEYS = f"game_date, {i8('team_id')}"


@query(
    "standings_asof",
    f"WITH {T.LOG_SQL}, {STANDINGS_SQL} SELECT {_STAND_KEYS}, conf, {i8('wins')}, {i8('losses')}, {r6('win_pct')} FROM standings",
)
def standings(spark, sf_dir):
    table = standings_asof(T.stored_log(spark, sf_dir, *T.RESULTS), T.conference())
    return tidy(table, "game_date", "team_id", "conf", "wins", "losses", "win_pct")


def _standing_query(name: str, column: str):
    column_sql = r6(column) if column == "games_back" else i8(column)

    @query(name, f"WITH {T.LOG_SQL}, {STANDINGS_SQL} SELECT {_STAND_KEYS}, {column_sql} FROM standings")
    def run(spark, sf_dir):
        return tidy(standings_asof(T.stored_log(spark, sf_dir, *T.RESULTS), T.conference()), "game_date", "team_id", column)


for _name, _column in (("games_back", "games_back"), ("conf_rank", "conf_rank"), ("league_rank", "league_rank"), ("signed_streak", "streak")):
    _standing_query(_name, _column)

STANDINGS_DAY = "1998-01-15"


@query(
    "standings_at_date",
    f"""WITH {T.LOG_SQL}, past AS (
      SELECT *, sum(CASE WHEN wl IN ('W', 'L') THEN 1 ELSE 0 END) OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS at_no
      FROM log WHERE game_date < DATE '{STANDINGS_DAY}'),
    rec AS (SELECT team_id, CASE WHEN team_id < 15 THEN 'East' ELSE 'West' END AS conf,
             sum(CASE WHEN wl = 'W' THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN wl = 'L' THEN 1 ELSE 0 END) AS losses,
             coalesce(max(CASE WHEN wl = 'W' THEN at_no END), 0) - coalesce(max(CASE WHEN wl = 'L' THEN at_no END), 0) AS streak
      FROM past GROUP BY team_id),
    pct AS (SELECT *, CASE WHEN wins + losses > 0 THEN CAST(wins AS DOUBLE) / (wins + losses) ELSE 0.5 END AS win_pct FROM rec)
    SELECT {i8('team_id')}, conf, {i8('wins')}, {i8('losses')}, {r6('win_pct')}, {i8('streak')},
           {i8('rank() OVER (PARTITION BY conf ORDER BY win_pct DESC)', 'conf_rank')},
           {i8('rank() OVER (ORDER BY win_pct DESC)', 'league_rank')},
           {r6('(max(wins) OVER (PARTITION BY conf) - wins + losses - min(losses) OVER (PARTITION BY conf)) / 2', 'games_back')} FROM pct""",
)
def standings_on_day(spark, sf_dir):
    table = standings_at_date(T.game_log(spark, sf_dir), STANDINGS_DAY, T.conference())
    return tidy(table, "team_id", "conf", *STANDINGS_DEFAULTS)


_SIDES_STANDINGS = [(side, c) for side in ("home", "away") for c in STANDINGS_DEFAULTS]


def _standing_value(side: str, column: str) -> str:
    default = STANDINGS_DEFAULTS[column]
    value = f"coalesce({side[0]}s.{column}, {default})"
    name = f"{side}_{column}"
    return r6(value, name) if isinstance(default, float) else i8(value, name)


_STANDINGS_JOIN = """LEFT JOIN standings hs ON hs.game_date = c.game_date AND hs.team_id = c.home_team_id
    LEFT JOIN standings aws ON aws.game_date = c.game_date AND aws.team_id = c.away_team_id""".replace("aws", '"as"')
_standing_value_sql = lambda s, c: _standing_value(s, c).replace("as.", '"as".')


@query(
    "matchup_standings",
    f"WITH {T.CONTESTS_SQL}, {STANDINGS_SQL} SELECT {i8('c.game_id', 'game_id')}, "
    f"{', '.join(_standing_value_sql(s, c) for s, c in _SIDES_STANDINGS)} FROM contests c {_STANDINGS_JOIN}",
)
def matchup_standings(spark, sf_dir):
    log = T.stored_log(spark, sf_dir)
    joined = with_standings(G.valid_contests(log), standings_asof(log, T.conference(), asked=own_days(log)))
    return tidy(joined, "game_id", *[f"{s}_{c}" for s, c in _SIDES_STANDINGS])


@query(
    "standings_diff",
    f"""WITH {T.CONTESTS_SQL}, {STANDINGS_SQL} SELECT {i8('c.game_id', 'game_id')},
    {i8('hs.conf_rank - "as".conf_rank', 'rank_diff')}, {r6('hs.win_pct - "as".win_pct', 'win_pct_diff')} FROM contests c {_STANDINGS_JOIN}""",
)
def standings_diff(spark, sf_dir):
    log = T.stored_log(spark, sf_dir)
    joined = with_standings(G.valid_contests(log), standings_asof(log, T.conference(), asked=own_days(log)))
    return tidy(joined, "game_id", "rank_diff", "win_pct_diff")


# --- head-to-head ----------------------------------------------------------

MEETINGS_SQL = """
meetings AS (
  SELECT game_id, game_date, home_team_id AS team_id, away_team_id AS opp_id, home_wl AS wl, home_plus_minus AS diff FROM contests
  UNION ALL
  SELECT game_id, game_date, away_team_id, home_team_id, away_wl, away_plus_minus FROM contests)"""
H2H_SQL = f"""{MEETINGS_SQL},
pair_day AS (SELECT DISTINCT team_id, opp_id, game_date FROM meetings),
h2h AS (
  SELECT d.team_id, d.opp_id, d.game_date, coalesce(x.rate, 0.5) AS h2h_win_rate, coalesce(x.n, 0) AS h2h_games,
         CASE WHEN coalesce(x.n, 0) = 0 THEN 0 ELSE x.diff END AS h2h_pts_diff
  FROM pair_day d LEFT JOIN LATERAL (
    SELECT avg(CASE WHEN y.wl = 'W' THEN 1 ELSE 0 END) AS rate, count(*) AS n, avg(y.diff) AS diff FROM (
      SELECT m.wl, m.diff FROM meetings m WHERE m.team_id = d.team_id AND m.opp_id = d.opp_id AND m.game_date < d.game_date
      ORDER BY m.game_date DESC, m.game_id DESC LIMIT 10) y) x ON true)"""


@query(
    "h2h_asof",
    f"WITH {T.CONTESTS_SQL}, {H2H_SQL} SELECT {i8('team_id')}, {i8('opp_id')}, game_date, {r6('h2h_win_rate')}, {i8('h2h_games')}, {r6('h2h_pts_diff')} FROM h2h",
)
def head_to_head_asof(spark, sf_dir):
    return tidy(h2h_asof(G.valid_contests(T.game_log(spark, sf_dir))), "team_id", "opp_id", "game_date", *H2H_DEFAULTS)


@query(
    "h2h_latest",
    f"""WITH {T.CONTESTS_SQL}, {MEETINGS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY team_id, opp_id ORDER BY game_date DESC, game_id DESC) AS k FROM meetings)
    SELECT {i8('team_id')}, {i8('opp_id')}, {r6("avg(CASE WHEN wl = 'W' THEN 1 ELSE 0 END)", 'h2h_win_rate')},
           count(*) AS h2h_games, {r6('coalesce(avg(diff), 0)', 'h2h_pts_diff')} FROM ranked WHERE k <= 10 GROUP BY team_id, opp_id""",
)
def head_to_head_latest(spark, sf_dir):
    return tidy(h2h_latest(G.valid_contests(T.game_log(spark, sf_dir))), "team_id", "opp_id", *H2H_DEFAULTS)


# --- the wide table --------------------------------------------------------

_SIDE = side_features()
_REAL = lambda c: not c.endswith(FLAGS)
_num = lambda expr, name: r6(expr, name) if _REAL(name) else i8(expr, name)
MATCHED_SQL = f"""{FORM_SQL},
ready AS (SELECT * FROM form WHERE {_READY}),
matched AS (
  SELECT h.game_id, h.game_date, h.team_id AS home_team_id, a.team_id AS away_team_id, CASE WHEN h.wl = 'W' THEN 1 ELSE 0 END AS home_win,
         {', '.join(f'{p}.{c} AS {s}_{c}' for s, p in (('home', 'h'), ('away', 'a')) for c in _SIDE)}
  FROM ready h JOIN ready a ON h.game_id = a.game_id AND h.at_home AND NOT a.at_home)"""
_META_SQL = f"{i8('c.game_id', 'game_id')}, c.game_date, {i8('c.home_team_id', 'home_team_id')}, {i8('c.away_team_id', 'away_team_id')}, {i8('home_win')}"


@query(
    "matchups",
    f"WITH {MATCHED_SQL} SELECT {_META_SQL}, {', '.join(_num(f'{s}_{c}', f'{s}_{c}') for s in ('home', 'away') for c in _SIDE)} FROM matched c",
)
def matchups(spark, sf_dir):
    return tidy(matched_sides(form_features(narrow_log(T.form_log(spark, sf_dir)), ewm=False, derive=G.with_ratios)))


_H2H_JOIN = """LEFT JOIN h2h hh ON hh.game_date = c.game_date AND hh.team_id = c.home_team_id AND hh.opp_id = c.away_team_id
    LEFT JOIN h2h ah ON ah.game_date = c.game_date AND ah.team_id = c.away_team_id AND ah.opp_id = c.home_team_id"""
_H2H_VALUES = [
    (i8 if c == "h2h_games" else r6)(f"{p}.{c}", f"{s}_{c}") for s, p in (("home", "hh"), ("away", "ah")) for c in H2H_DEFAULTS
]
# The log CTEs are part of FORM_SQL, so only the contests CTE is added here.
_CONTESTS_ONLY = T.CONTESTS_SQL[len(T.LOG_SQL) + 1 :]
TABLE_SQL = f"""{MATCHED_SQL}, {_CONTESTS_ONLY}, {STANDINGS_SQL}, {H2H_SQL},
contest_table AS (SELECT {_META_SQL}, {', '.join(_num(f'{s}_{c}', f'{s}_{c}') for s in ('home', 'away') for c in _SIDE)},
  {', '.join(_H2H_VALUES)}, {', '.join(_standing_value_sql(s, c) for s, c in _SIDES_STANDINGS)},
  {i8('hs.conf_rank - "as".conf_rank', 'rank_diff')}, {r6('hs.win_pct - "as".win_pct', 'win_pct_diff')}
  FROM matched c {_H2H_JOIN} {_STANDINGS_JOIN})"""


def wide_table(spark, sf_dir):
    return contest_table(T.stored_log(spark, sf_dir), T.conference())


@query("contest_table", f"WITH {TABLE_SQL} SELECT * FROM contest_table")
def contests_wide(spark, sf_dir):
    return tidy(wide_table(spark, sf_dir))


@query("feature_columns", f"WITH {TABLE_SQL} SELECT count(*) AS n, CAST(112 AS BIGINT) AS n_features, CAST(117 AS BIGINT) AS n_columns FROM contest_table")
def feature_column_count(spark, sf_dir):
    table = wide_table(spark, sf_dir)
    features = feature_columns(table.columns)
    return tidy(
        table.agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_features", F.lit(len(features)))
        .withColumn("n_columns", F.lit(len(contest_columns())))
    )


@query("validate_frame", f"WITH {TABLE_SQL} SELECT count(*) AS n, {i8('sum(home_win)', 'home_wins')} FROM contest_table")
def validated(spark, sf_dir):
    table = wide_table(spark, sf_dir)
    validate_frame(table, ("home_pts_roll_mean", "rank_diff"))
    return tidy(table.agg(F.count(F.lit(1)).alias("n"), F.sum("home_win").alias("home_wins")))


_DIFFS = [c for c in _SIDE] + list(H2H_DEFAULTS) + list(STANDINGS_DEFAULTS)
_INTS = (*FLAGS, "h2h_games", "wins", "losses", "conf_rank", "league_rank", "streak")
_SHOWN = ("pts_roll_mean", "efg_pct_roll_mean", "win_streak", "days_rest", "is_home", "h2h_games", "wins", "win_pct")


@query(
    "differentials",
    f"WITH {TABLE_SQL} SELECT game_id, {', '.join((i8 if c in _INTS else r6)(f'home_{c} - away_{c}', f'diff_{c}') for c in _SHOWN)} FROM contest_table",
)
def side_differences(spark, sf_dir):
    return tidy(differentials(tidy(wide_table(spark, sf_dir))), "game_id", *[f"diff_{c}" for c in _SHOWN])


_VECTOR = ("home_pts_roll_mean", "away_win_streak", "home_h2h_win_rate", "rank_diff", "home_roll_avg_pts", "away_days_rest_extra", "bookmaker_count")
_VECTOR_SQL = ("home_pts_roll_mean", "away_win_streak", "home_h2h_win_rate", "CAST(rank_diff AS DOUBLE)", "110.0", "2.0", "0.0")


@query(
    "feature_vector",
    f"WITH {TABLE_SQL} SELECT game_id, {', '.join(r6(e, f'v{i}') for i, e in enumerate(_VECTOR_SQL))} FROM contest_table",
)
def vector(spark, sf_dir):
    rows = feature_vector(wide_table(spark, sf_dir), list(_VECTOR))
    return tidy(rows.select("game_id", *[F.col("feature_array")[i].alias(f"v{i}") for i in range(len(_VECTOR))]))


_DEFAULTED = ("roll_avg_pts", "win_streak", "recent_form", "days_rest", "pts_roll_mean")


@query(
    "feature_defaults",
    f"WITH {FORM_SQL} SELECT {i8('game_id')}, {i8('team_id')}, {r6('110.0', 'roll_avg_pts')}, "
    f"{r6('coalesce(win_streak, 0)', 'win_streak')}, {r6('coalesce(recent_form, 0.5)', 'recent_form')}, "
    f"{r6('coalesce(days_rest, 2)', 'days_rest')}, {r6('coalesce(pts_roll_mean, 0)', 'pts_roll_mean')} FROM form",
)
def defaults(spark, sf_dir):
    return tidy(defaulted(spark, sf_dir), "game_id", "team_id", *_DEFAULTED)


def defaulted(spark, sf_dir):
    """Every form column with its default where it is missing, stored, so that all of them are computed."""
    rows = form_features(narrow_log(T.form_log(spark, sf_dir)), derive=G.with_ratios)
    rolled = [f"{s}_{kind}" for s in ROLLED_STATS for kind in ("roll_mean", "roll_std", "ewm")]
    value = lambda c: F.coalesce(F.col(c), F.lit(default_for(c))) if c in rows.columns else F.lit(default_for(c))
    names = dict.fromkeys([*_DEFAULTED, *rolled, *FORM_COLUMNS])
    return stored(rows.select("game_id", "team_id", *[value(c).alias(c) for c in names]), "defaulted")


SPLIT_SQL = f"""{T.CONTESTS_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY game_date, game_id) AS time_rank, count(*) OVER () AS n FROM contests),
split AS (SELECT *, n - CAST(ceil(n * 0.2) AS BIGINT) AS n_train FROM ranked)"""


@query("chrono_split", f"WITH {SPLIT_SQL} SELECT {i8('game_id')}, {i8('time_rank')}, time_rank > n_train AS is_test FROM split")
def split_by_time(spark, sf_dir):
    return tidy(chronological_split(G.valid_contests(T.game_log(spark, sf_dir))), "game_id", "time_rank", "is_test")


@query(
    "recency_weights",
    f"WITH {SPLIT_SQL} SELECT {i8('game_id')}, {r6('exp(-1.2 + 1.2 * (time_rank - 1) / (n_train - 1))', 'sample_weight')} FROM split WHERE time_rank <= n_train",
)
def weights_by_time(spark, sf_dir):
    split = chronological_split(G.valid_contests(T.game_log(spark, sf_dir)))
    return tidy(with_recency_weights(split), "game_id", "sample_weight")


# --- ratings ---------------------------------------------------------------

_PLAY = "1 / (1 + pow(CAST(10 AS DOUBLE), (r.st[g.away_team_id + 1] - r.st[g.home_team_id + 1] - 100) / 400))"
ELO_SQL = f"""{T.CONTESTS_SQL},
g AS (SELECT season, game_id, home_team_id, away_team_id, CASE WHEN home_wl = 'W' THEN 1 ELSE 0 END AS won,
             row_number() OVER (PARTITION BY season ORDER BY game_date, game_id) AS rn FROM contests),
r(season, rn, st) AS (
  SELECT DISTINCT season, CAST(0 AS BIGINT), list_transform(range(30), lambda x: CAST(1500 AS DOUBLE)) FROM g
  UNION ALL
  SELECT g.season, g.rn, list_transform(range(30), lambda i: CASE
      WHEN i = g.home_team_id THEN r.st[i + 1] + 20 * (g.won - {_PLAY})
      WHEN i = g.away_team_id THEN r.st[i + 1] - 20 * (g.won - {_PLAY})
      ELSE r.st[i + 1] END)
  FROM r JOIN g ON g.season = r.season AND g.rn = r.rn + 1),
elo AS (
  SELECT g.season, g.game_id, g.home_team_id, g.away_team_id, r.st[g.home_team_id + 1] AS elo_home, r.st[g.away_team_id + 1] AS elo_away, {_PLAY} AS elo_prob_home
  FROM g JOIN r ON g.season = r.season AND r.rn = g.rn - 1)"""


# One pool over all seasons: ratings move towards the start where a season follows another.
SEASONS_ELO_SQL = f"""{T.CONTESTS_SQL},
g AS (SELECT *, coalesce(season <> lag(season) OVER (ORDER BY rn), FALSE) AS began FROM (
      SELECT season, game_id, home_team_id, away_team_id, CASE WHEN home_wl = 'W' THEN 1 ELSE 0 END AS won,
             row_number() OVER (ORDER BY game_date, game_id) AS rn FROM contests)),
r(rn, st) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(30), lambda x: CAST(1500 AS DOUBLE))
  UNION ALL
  SELECT rn, list_transform(range(30), lambda i: CASE
      WHEN i = home_team_id THEN st[i + 1] + 20 * (won - p) WHEN i = away_team_id THEN st[i + 1] - 20 * (won - p) ELSE st[i + 1] END)
  FROM (SELECT *, 1 / (1 + pow(CAST(10 AS DOUBLE), (st[away_team_id + 1] - st[home_team_id + 1] - 100) / 400)) AS p
        FROM (SELECT g.*, CASE WHEN began THEN list_transform(r.st, lambda x: CAST(0.75 AS DOUBLE) * x + CAST(375 AS DOUBLE)) ELSE r.st END AS st
              FROM r JOIN g ON g.rn = r.rn + 1))),
elo AS (
  SELECT game_id, st[home_team_id + 1] AS elo_home, st[away_team_id + 1] AS elo_away,
         1 / (1 + pow(CAST(10 AS DOUBLE), (st[away_team_id + 1] - st[home_team_id + 1] - 100) / 400)) AS elo_prob_home
  FROM (SELECT g.*, CASE WHEN began THEN list_transform(r.st, lambda x: CAST(0.75 AS DOUBLE) * x + CAST(375 AS DOUBLE)) ELSE r.st END AS st
        FROM g JOIN r ON g.rn = r.rn + 1))"""


def _rated(spark, sf_dir):
    return R.elo_ratings(T.stored_contests(spark, sf_dir), pool="season")


@query(
    "elo_ratings",
    f"WITH RECURSIVE {ELO_SQL} SELECT season AS pool, {i8('game_id')}, {r6('elo_home')}, {r6('elo_away')}, {r6('elo_home - elo_away', 'elo_diff')}, {r6('elo_prob_home')} FROM elo",
)
def elo(spark, sf_dir):
    return tidy(_rated(spark, sf_dir))


@query(
    "elo_log",
    f"""WITH RECURSIVE {ELO_SQL} SELECT {i8('l.game_id', 'game_id')}, {i8('l.team_id', 'team_id')}, {r6('coalesce(e.elo_home, 0)', 'elo_home')},
    {r6('coalesce(e.elo_away, 0)', 'elo_away')}, {r6('coalesce(e.elo_home - e.elo_away, 0)', 'elo_diff')} FROM log l LEFT JOIN elo e USING (game_id)""",
)
def elo_on_log(spark, sf_dir):
    return tidy(R.with_elo(T.game_log(spark, sf_dir), _rated(spark, sf_dir)), "game_id", "team_id", "elo_home", "elo_away", "elo_diff")


@query(
    "elo_expected",
    f"""WITH RECURSIVE {ELO_SQL} SELECT {i8('game_id')}, {r6('1 / (1 + pow(CAST(10 AS DOUBLE), (elo_away - elo_home) / 400))', 'expected_home')},
    {r6('1 / (1 + pow(CAST(10 AS DOUBLE), (elo_home - elo_away) / 400))', 'expected_away')} FROM elo""",
)
def elo_expected(spark, sf_dir):
    rated = _rated(spark, sf_dir)
    home, away = F.col("elo_home"), F.col("elo_away")
    return tidy(
        rated.select("game_id", R.expected_score(home, away).alias("expected_home"), R.expected_score(away, home).alias("expected_away"))
    )


@query(
    "elo_step",
    f"""WITH RECURSIVE {ELO_SQL} SELECT {i8('e.game_id', 'game_id')}, {r6('20 * (g.won - elo_prob_home)', 'change')},
    {r6('elo_home + 20 * (g.won - elo_prob_home)', 'new_home')}, {r6('elo_away - 20 * (g.won - elo_prob_home)', 'new_away')}
    FROM elo e JOIN g USING (game_id)""",
)
def elo_step(spark, sf_dir):
    contests = T.stored_contests(spark, sf_dir)
    rated = R.elo_ratings(contests, pool="season").join(contests.select("game_id", (F.col("home_wl") == "W").cast("int").alias("won")), "game_id")
    change = R.rating_change(F.col("elo_home"), F.col("elo_away"), F.col("won"))
    return tidy(
        rated.withColumn("change", change)
        .withColumn("new_home", F.col("elo_home") + F.col("change"))
        .withColumn("new_away", F.col("elo_away") - F.col("change")),
        "game_id", "change", "new_home", "new_away",
    )


CURRENT_SQL = f"""{ELO_SQL},
last AS (SELECT season, max(rn) AS rn FROM g GROUP BY season),
played AS (SELECT DISTINCT season, team_id FROM (SELECT season, home_team_id AS team_id FROM g UNION ALL SELECT season, away_team_id FROM g)),
current AS (SELECT p.season AS pool, p.team_id, r.st[p.team_id + 1] AS rating FROM played p JOIN last USING (season) JOIN r ON r.season = p.season AND r.rn = last.rn)"""


def _current(spark, sf_dir):
    return R.elo_current(T.stored_contests(spark, sf_dir), pool="season")


@query("elo_current", f"WITH RECURSIVE {CURRENT_SQL} SELECT pool, {i8('team_id')}, {r6('rating')} FROM current")
def elo_now(spark, sf_dir):
    return tidy(_current(spark, sf_dir), "pool", "team_id", "rating")


@query("elo_season_reset", f"WITH RECURSIVE {CURRENT_SQL} SELECT pool, {i8('team_id')}, {r6('0.75 * rating + 0.25 * 1500', 'rating')} FROM current")
def elo_reset(spark, sf_dir):
    return tidy(_current(spark, sf_dir).withColumn("rating", R.season_reset(F.col("rating"))), "pool", "team_id", "rating")


@query("top_ratings", f"WITH RECURSIVE {CURRENT_SQL} SELECT {i8('team_id')}, {r6('rating')} FROM current WHERE pool = '{'1997-98'}' ORDER BY rating DESC, team_id LIMIT 5")
def best_ratings(spark, sf_dir):
    return tidy(R.top_ratings(_current(spark, sf_dir).filter("pool = '1997-98'")), "team_id", "rating")


@query(
    "rating_profile",
    f"""WITH RECURSIVE {ELO_SQL} SELECT season AS pool, {r6('min(elo_home)', 'low')}, {r6('max(elo_home)', 'high')}, round(avg(elo_home), 4) + 0.0 AS mean FROM elo GROUP BY season""",
)
def rating_profile(spark, sf_dir):
    return tidy(
        _rated(spark, sf_dir).groupBy("pool").agg(
            F.min("elo_home").alias("low"), F.max("elo_home").alias("high"), F.round(F.avg("elo_home"), 4).alias("mean")
        )
    )
