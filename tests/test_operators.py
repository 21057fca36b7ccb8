"""Literal cases and invariants of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paircast.functions import boxscore as B
from paircast.functions import prediction as P
from paircast.operators import games as G
from paircast.operators import h2h, history, odds, ratings, stats
from paircast.operators.form import form_features, latest_features, next_contest_features
from paircast.operators.preparation import default_for, feature_columns, recency_weight, validate_frame
from paircast.operators.standings import own_days, standings_asof, standings_at_date


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(inputs)], "i int, v double")
    return [r[1] for r in rows.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_tiers_at_their_edges(spark):
    got = values(spark, P.confidence_tier, [0.5, 0.4999, 0.4, 0.3, 0.2, 0.1, 0.0999, -0.2, 1.5])
    assert got == ["EXCELLENT", "STRONG", "STRONG", "GOOD", "MODERATE", "RISKY", "SKIP", "SKIP", "EXCELLENT"]


def test_prices(spark):
    assert values(spark, P.american_to_decimal, [150, -200, 100, -500, 500, 0]) == [2.5, 1.5, 2.0, 1.2, 6.0, None]
    assert values(spark, P.implied_probability, [2.0, 1.5, 0.0, -1.5]) == [0.5, pytest.approx(2 / 3), None, None]
    assert one(spark, P.overround(F.lit(1.9), F.lit(1.9)))[0] == pytest.approx(0.0526, abs=1e-4)


def test_winner_needs_more_than_the_threshold(spark):
    assert values(spark, P.predicted_label, [0.5, 0.51]) == [0, 1]
    assert values(spark, lambda v: P.predicted_label(v, 0.6), [0.6, 0.61]) == [0, 1]


def test_ensemble_arrays(spark):
    probs = F.array(*[F.lit(v) for v in (0.8, 0.7, 0.9)])
    mean, weighted, ignored, agree = one(
        spark, P.array_mean(probs), P.weighted_mean(probs, [1, 2, 1]), P.weighted_mean(probs, [1, 2]), P.model_agreement(probs)
    )
    assert (mean, weighted, ignored) == (pytest.approx(0.8), pytest.approx(0.775), pytest.approx(0.8))
    assert agree == pytest.approx(1 - 0.0816496, abs=1e-6)


def test_zero_denominators_count_as_one(spark):
    box = dict(fgm=0, fga=0, fg3m=0, fg3a=3, fta=0, oreb=0, dreb=0, reb=2, ast=5, tov=0, pts=4)
    row = G.advanced_metrics(G.four_factors(spark.createDataFrame([box]))).first()
    assert (row.efg_pct, row.ts_pct, row.ast_to_ratio, row.fg3a_rate, row.reb_diff) == (0, 4, 5, 3, 2)


def test_fatigue(spark):
    score = lambda r, b, t: one(spark, B.fatigue_score(F.lit(r), F.lit(b), F.lit(t)))[0]
    assert score(3, 0, 0) == 0 and score(1, 1, 0) == pytest.approx(0.5) and score(0, 1, 1) == 1.0


def test_season_label(spark):
    days = spark.createDataFrame([(dt.date(1999, 9, 30),), (dt.date(1999, 10, 1),), (dt.date(2024, 1, 5),)], "d date")
    assert [r[0] for r in days.select(B.season_label(F.col("d"))).collect()] == ["1998-99", "1999-00", "2023-24"]


# --- validity, results, boards ------------------------------------------------


def log_of(spark, rows):
    """rows: (game, day, team, opponent, side, result, diff)"""
    data = [
        (g, dt.date(2024, 1, 1) + dt.timedelta(days=d), t, f"{t} {'vs.' if s == 'h' else '@'} {o}", r, p, "2023-24", f"Team {t}", t)
        for g, d, t, o, s, r, p in rows
    ]
    columns = "game_id int, game_date date, team_id int, matchup string, wl string, plus_minus double, season string, team_name string, team_abbr string"
    return spark.createDataFrame(data, columns)


def test_valid_contests_need_one_row_per_side(spark):
    log = log_of(
        spark,
        [
            (1, 0, 1, 2, "h", "W", 5.0), (1, 0, 2, 1, "a", "L", -5.0),
            (2, 1, 1, 2, "h", "W", 5.0),
            (3, 2, 1, 2, "h", "W", 5.0), (3, 2, 2, 1, "h", "L", -5.0),
            (4, 3, 1, 2, "h", "W", 5.0), (4, 3, 2, 1, "a", "L", -5.0), (4, 3, 3, 1, "a", "L", -5.0),
        ],
    )
    assert [r.game_id for r in G.valid_contests(log).collect()] == [1]


def test_exhibition_split_names_unknown_teams(spark):
    teams = spark.createDataFrame([(1, "One"), (2, "Two")], "id int, full_name string")
    games = spark.createDataFrame([(10, 1, 2), (11, 1, 99), (12, None, 2)], "game_id int, home_team_id int, away_team_id int")
    regular, skipped = G.split_exhibition(games, teams)
    assert [r.game_id for r in regular.collect()] == [10]
    names = {r.game_id: (r.home_name, r.away_name) for r in skipped.collect()}
    assert names == {11: ("One", "Team #99"), 12: ("Team #None", "Two")}


def test_first_source_with_rows_wins_per_day(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "day int, game int")
    best = G.lowest_priority([rows((1, 10)), rows((1, 11), (2, 20)), rows((2, 21), (3, 30))], ["day"])
    assert sorted((r.day, r.game, r.source_rank) for r in best.collect()) == [(1, 10, 1), (2, 20, 2), (3, 30, 3)]


# --- form ----------------------------------------------------------------------


def test_form_never_sees_its_own_contest(spark, log):
    rich = G.advanced_metrics(G.four_factors(log))
    key = log.orderBy(F.desc("game_date"), F.desc("game_id")).select("game_id", "team_id").first()
    here = (F.col("game_id") == key.game_id) & (F.col("team_id") == key.team_id)
    changed = rich.withColumn("pts", F.when(here, 9999).otherwise(F.col("pts"))).withColumn(
        "wl", F.when(here, F.when(F.col("wl") == "W", "L").otherwise("W")).otherwise(F.col("wl"))
    )
    pick = lambda df: form_features(df, stats=("pts",)).filter(here).drop("pts", "wl").collect()
    assert pick(rich) == pick(changed)


def test_form_of_a_short_history(spark):
    results = "WLWWLW"
    log = log_of(spark, [(i, i * (1 if i < 3 else 2), 1, 2, "h", r, 1.0) for i, r in enumerate(results)]).withColumn("pts", F.col("game_id") * 10)
    rows = form_features(log, stats=("pts",)).orderBy("game_id").collect()
    assert [r.win_pattern_3game for r in rows] == [None, 3.5, 2.0, 5.0, 3.0, 6.0]
    assert [r.win_streak for r in rows] == [None, 1.0, 1.0, 2.0, 3.0, 3.0]
    assert [r.days_rest for r in rows] == [3.0, 1.0, 1.0, 4.0, 2.0, 2.0]
    assert [r.is_3_in_4 for r in rows] == [0, 1, 1, 0, 0, 0]
    assert [r.pts_roll_mean for r in rows] == [None] * 5 + [20.0]
    assert rows[5].pts_roll_std == pytest.approx(15.811388)
    weights = [(9 / 11) ** k for k in range(5)]
    assert rows[5].pts_ewm == pytest.approx(sum(w * v for w, v in zip(weights, (40, 30, 20, 10, 0))) / sum(weights))
    assert latest_features(form_features(log, stats=("pts",))).first().game_id == 5


def test_next_contest_counts_the_newest_result(spark):
    log = log_of(spark, [(i, i, 1, 2, "h", "W", 1.0) for i in range(6)]).withColumn("pts", F.lit(10))
    upcoming = log_of(spark, [(99, 7, 1, 2, "h", None, None)]).drop("wl", "plus_minus")
    row = next_contest_features(log, upcoming, stats=("pts",)).first()
    assert (row.game_id, row.win_streak, row.days_rest, row.pts_roll_mean) == (99, 5.0, 2.0, 10.0)


def test_missing_values_keep_their_place_in_the_exponential_mean(spark):
    points = [10.0, None, 30.0, 40.0, 50.0, 60.0, 70.0]
    log = log_of(spark, [(i, i, 1, 2, "h", "W", p) for i, p in enumerate(points)]).withColumnRenamed("plus_minus", "pts")
    row = form_features(log, stats=("pts",), momentum=False).filter("game_id = 6").first()
    used = [(k, p) for k, p in enumerate(reversed(points[:6])) if p is not None]
    assert row.pts_ewm == pytest.approx(sum((9 / 11) ** k * p for k, p in used) / sum((9 / 11) ** k for k, _ in used))
    assert row.pts_roll_mean == pytest.approx(38.0)


# --- standings and head-to-head ---------------------------------------------------


def test_standings_before_each_day(spark):
    log = log_of(
        spark,
        [
            (1, 0, 1, 2, "h", "W", 1.0), (1, 0, 2, 1, "a", "L", -1.0),
            (2, 1, 1, 2, "h", "W", 1.0), (2, 1, 2, 1, "a", "L", -1.0),
            (3, 2, 1, 2, "h", "L", -1.0), (3, 2, 2, 1, "a", "W", 1.0), (4, 3, 3, 1, "h", None, None),
        ],
    )
    east = F.lit("East")
    table = {(r.game_date.day, r.team_id): r for r in standings_asof(log, east).collect()}
    assert len(table) == 12
    assert [table[d, 1].streak for d in (1, 2, 3, 4)] == [0, 1, 2, -1]
    assert (table[1, 3].win_pct, table[1, 3].conf_rank) == (0.5, 1)
    assert (table[3, 2].wins, table[3, 2].losses, table[3, 2].games_back, table[3, 2].league_rank) == (0, 2, 2.0, 3)
    at_day = {r.team_id: r for r in standings_at_date(log, "2024-01-04", east).collect()}
    assert set(at_day) == {1, 2} and at_day[1].wins == 2 and at_day[2].streak == 1


def _season_log(spark):
    rng = random.Random(6)
    rows = []
    for g in range(160):
        a, b = rng.sample(range(1, 10), 2)
        won = rng.choice([True, True, False, None])
        mark = (None, None) if won is None else ("W", "L") if won else ("L", "W")
        rows += [(g, g // 3 * 2, a, b, "h", mark[0], 1.0), (g, g // 3 * 2, b, a, "a", mark[1], -1.0)]
    return log_of(spark, rows)


def _standings_by_force(log, conf_of):
    rows = [r.asDict() for r in log.orderBy("game_date", "game_id").collect()]
    out = {}
    teams = {r["team_id"] for r in rows}
    for day in {r["game_date"] for r in rows}:
        table = {}
        for t in teams:
            results = [r["wl"] for r in rows if r["team_id"] == t and r["game_date"] < day and r["wl"] in ("W", "L")]
            wins, losses = results.count("W"), results.count("L")
            streak = 0
            for x in reversed(results):
                if x != results[-1]:
                    break
                streak += 1 if x == "W" else -1
            table[t] = (wins, losses, streak, wins / (wins + losses) if results else 0.5)
        for t, (wins, losses, streak, pct) in table.items():
            peers = [v for u, v in table.items() if conf_of(u) == conf_of(t)]
            back = (max(v[0] for v in peers) - wins + losses - min(v[1] for v in peers)) / 2
            ranks = 1 + sum(v[3] > pct for v in peers), 1 + sum(v[3] > pct for v in table.values())
            out[day, t] = (wins, losses, streak, pct, *ranks, back)
    return out


def test_standings_by_force(spark):
    log = _season_log(spark)
    want = _standings_by_force(log, lambda t: None if t == 9 else t < 5)
    conf = F.when(F.col("team_id") < 5, "East").when(F.col("team_id") < 9, "West")  # one team has no conference
    pick = lambda df: {(r.game_date, r.team_id): (r.wins, r.losses, r.streak, r.win_pct, r.conf_rank, r.league_rank, r.games_back) for r in df.collect()}
    full = pick(standings_asof(log, conf))
    assert full == want
    own = pick(standings_asof(log, conf, asked=own_days(log)))
    assert own == {k: v for k, v in want.items() if k in own} and len(own) == own_days(log).count()
    by_cohort = log.withColumn("season", F.lit("s"))
    assert pick(standings_asof(by_cohort, conf, "season", own_days(by_cohort, "season"))) == own


def test_lookups_make_no_product_of_entities_and_days(spark):
    log = _season_log(spark)
    plan = standings_asof(log, F.lit("East"), asked=own_days(log))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_head_to_head_window_and_defaults(spark):
    rows = []
    for i in range(12):
        rows += [(i, i // 2, 1, 2, "h", "W" if i % 4 else "L", 4.0), (i, i // 2, 2, 1, "a", "L" if i % 4 else "W", -4.0)]
    contests = G.valid_contests(log_of(spark, rows))
    latest = {(r.team_id, r.opp_id): r for r in h2h.h2h_latest(contests).collect()}
    assert latest[1, 2].h2h_games == 10 and latest[1, 2].h2h_win_rate == pytest.approx(0.8)
    past = {(r.team_id, r.game_date.day): r for r in h2h.h2h_asof(contests).collect()}
    assert (past[1, 1].h2h_games, past[1, 1].h2h_win_rate, past[1, 1].h2h_pts_diff) == (0, 0.5, 0.0)
    assert past[1, 2].h2h_games == 2 and past[2, 6].h2h_games == 10 and past[2, 6].h2h_pts_diff == -4.0


# --- ratings -----------------------------------------------------------------------


def test_expected_scores(spark):
    even, gap, mirror = one(
        spark, ratings.expected_score(F.lit(1500.0), F.lit(1500.0)), ratings.expected_score(F.lit(1900.0), F.lit(1500.0)),
        ratings.expected_score(F.lit(1500.0), F.lit(1900.0)),
    )
    assert even == 0.5 and gap == pytest.approx(0.909, abs=1e-3) and gap + mirror == pytest.approx(1)
    assert one(spark, ratings.season_reset(F.lit(1700.0), 0.0), ratings.season_reset(F.lit(1700.0), 1.0)) == (1500.0, 1700.0)


@pytest.fixture(scope="module")
def contests(log):
    return G.valid_contests(log)


def sequential(rows):
    """Plain replay of all contests, season changes included."""
    state, season, out = {}, None, {}
    for r in rows:
        if season is not None and r.season != season:
            state = {t: 0.75 * v + 0.25 * 1500 for t, v in state.items()}
        season = r.season
        a, b = state.get(r.home_team_id, 1500.0), state.get(r.away_team_id, 1500.0)
        p = 1 / (1 + 10 ** ((b - a - 100) / 400))
        change = 20 * ((r.home_wl == "W") - p)
        state[r.home_team_id], state[r.away_team_id] = a + change, b - change
        out[r.game_id] = (a, b, p)
    return out, state


@pytest.mark.parametrize("block", [10**6, 150, 40])
def test_blocks_give_the_sequential_ratings(contests, block):
    expected, final = sequential(contests.orderBy("game_date", "game_id").collect())
    rated = ratings.elo_ratings(contests, block_contests=block).collect()
    assert len(rated) == len(expected)
    for r in rated:
        assert (r.elo_home, r.elo_away, r.elo_prob_home) == pytest.approx(expected[r.game_id], abs=1e-6)
    if block == 150:
        current = {r.team_id: r.rating for r in ratings.elo_current(contests, block_contests=block).collect()}
        assert current == pytest.approx(final, abs=1e-6)
        assert sum(current.values()) == pytest.approx(1500 * len(current))


def test_unrated_rows_hold_zero_and_unknown_teams_start(spark, log, contests):
    rated = ratings.with_elo(log, ratings.elo_ratings(contests))
    valid = {r.game_id for r in contests.select("game_id").collect()}
    assert {r.game_id in valid for r in rated.filter("elo_home = 0").collect()} <= {False}
    teams = spark.createDataFrame([(1,), (999,)], "team_id int")
    current = spark.createDataFrame([(1, 1600.0)], "team_id int, rating double")
    assert {r.team_id: r.rating for r in ratings.ratings_of(teams, current).collect()} == {1: 1600.0, 999: 1500.0}


# --- odds ---------------------------------------------------------------------------


def test_fuzzy_match_equals_brute_force(spark):
    names = ["Los Angeles Lakers", "Los Angeles Clippers", "The Boston Celtics", "New York Knicks", "A Team"]
    day = dt.date(2024, 1, 1)
    games = [(i * 10 + j, day, h, a) for i, h in enumerate(names) for j, a in enumerate(names) if i != j]
    keys = ["boston celtics_vs_los angeles lakers", "lakers_vs_knicks", "clippers_vs_celtics", "no separator", "the_vs_a", "los angeles clippers_vs_new york knicks", "york_vs_angeles"]
    frame = spark.createDataFrame(games, "game_id int, game_date date, home_team string, away_team string")
    quotes = spark.createDataFrame([(day, k, i) for i, k in enumerate(keys)], "game_date date, game_key string, ordinal int")

    def words(text):
        return set(text.lower().split()) - {"the", "a", "an"}

    def brute(home, away):
        own = f"{home.lower()}_vs_{away.lower()}"
        if own in keys:
            return own
        for key in keys:
            parts = key.split("_vs_")
            if len(parts) == 2 and words(home) & words(parts[0]) and words(away) & words(parts[1]):
                return key
        return None

    got = {r.game_id: r.matched_key for r in odds.fuzzy_match(frame, quotes).collect()}
    assert got == {g: brute(h, a) for g, _, h, a in games}


def test_odds_features_of_several_bookmakers(spark):
    from paircast.sources.schemas import ODDS

    def book(home, away, key="h2h"):
        return {"key": "b", "title": "B", "markets": [{"key": key, "outcomes": [{"name": "H", "price": home}, {"name": "A", "price": away}]}]}

    rows = [
        {"id": "1", "home_team": "H", "away_team": "A", "bookmakers": [book(1.5, 2.5), book(1.7, 2.3), book(9.0, 9.0, "totals"), book(0.0, None)]},
        {"id": "2", "home_team": "H", "away_team": "A", "bookmakers": None},
    ]
    first, second = odds.odds_features(spark.createDataFrame(rows, ODDS), ["id"]).orderBy("id").collect()
    assert (first.home_avg_odds, first.home_best_odds, first.home_worst_odds, first.bookmaker_count) == (pytest.approx(1.6), 1.7, 1.5, 4)
    assert first.away_odds_spread == pytest.approx(0.2) and first.home_implied_prob == pytest.approx(1 / 1.6)
    assert second.home_avg_odds is None and second.bookmaker_count == 0


def test_merge_keeps_contests_single(spark):
    games = spark.createDataFrame([(1, dt.date(2024, 1, 1), "Lakers", "Celtics", 9.0), (2, dt.date(2024, 1, 2), "Lakers", "Celtics", None)], "game_id int, game_date date, home_team string, away_team string, home_avg_odds double")
    quotes = spark.createDataFrame([(dt.date(2024, 1, 1), " LAKERS ", "celtics", 1.5)] * 2, "game_date date, home_team string, away_team string, home_avg_odds double")
    merged = odds.merge_odds(games, quotes).orderBy("game_id")
    assert [r.home_avg_odds for r in merged.collect()] == [1.5, None]
    assert odds.match_rate(merged).first().match_rate == 50.0


# --- history and statistics ---------------------------------------------------------


def history_of(spark, results, prob=0.8):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), i, "A", "H", "H", "H" if r else "A", 0.6, prob, 0.97, "EXCELLENT", r) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "date date, game_id int, away_team string, home_team string, prediction string, winner string, confidence double, home_win_prob double, model_agreement double, tier string, correct int")


def test_streaks(spark):
    frame = history_of(spark, [1, 1, 0, 1, 1, 1, 0, 0])
    assert tuple(stats.current_streak(frame, ["game_id"]).first()) == ("L", 2)
    assert tuple(stats.longest_streaks(frame, ["game_id"]).first()) == (3, 2)
    assert tuple(stats.current_streak(history_of(spark, [1, 1]), ["game_id"]).first()) == ("W", 2)


def test_top_bucket_excludes_one(spark):
    assert stats.by_home_prob(history_of(spark, [1], prob=1.0)).count() == 0
    assert stats.by_home_prob(history_of(spark, [1], prob=0.75)).first().label == "75%+ home"


def test_filters_need_games_and_accuracy(spark):
    assert len(stats.filter_candidates()) == 32
    assert stats.profitable_filters(history_of(spark, [1] * 4)).count() == 0
    good = {r.name: r for r in stats.profitable_filters(history_of(spark, [1, 1, 1, 1, 0])).collect()}
    assert good["EXCELLENT + 95%+ agree"].accuracy == 80.0 and good["75%+ favorites"].roi == pytest.approx(12.8)
    assert "EXCELLENT + 98%+ agree" not in good and "All tiers + 95%+ agree" in good


def test_backfill_is_idempotent_and_new_rows_are_new(spark):
    frame = history_of(spark, [1, 0]).withColumn("winner", F.lit("")).withColumn("correct", F.lit(None).cast("int"))
    results = spark.createDataFrame([(dt.date(2024, 1, 1), "A", "H", "H")], "date date, away_team string, home_team string, winner string")
    once = history.backfill(frame, results)
    assert [(r.winner, r.correct) for r in once.orderBy("date").collect()] == [("H", 1), ("", None)]
    assert history.backfill(once, results).exceptAll(once).count() == 0
    assert history.new_rows(frame.withColumn("away_team", F.when(F.col("game_id") == 0, "A").otherwise("B")), frame).count() == 1


# --- preparation -------------------------------------------------------------------


def test_preparation(spark):
    assert feature_columns(["game_id", "x", "home_win", "y"], ("y",)) == ["x"]
    assert (default_for("HOME_ROLL_AVG_PTS"), default_for("away_days_rest"), default_for("pts_roll_mean")) == (110.0, 2.0, 0.0)
    first, last = one(spark, recency_weight(F.lit(1), F.lit(100)), recency_weight(F.lit(100), F.lit(100)))
    assert first == pytest.approx(0.3012, abs=1e-4) and last == 1.0
    with pytest.raises(ValueError, match="lacks the label"):
        validate_frame(spark.range(1))
    with pytest.raises(ValueError, match="empty"):
        validate_frame(spark.range(0))
    with pytest.raises(ValueError, match="lacks columns"):
        validate_frame(spark.range(1).withColumn("home_win", F.lit(1)), ("a",))
