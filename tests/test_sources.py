"""Payloads, files and incremental writes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paircast.sources import files, payloads, schemas
from paircast.streaming import streams


def payload(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "payload string")


def test_result_set_finds_columns_by_header(spark):
    frame = payload(spark, {"resultSets": [{"headers": ["A", "B"], "rowSet": [[1, "x"], [None, "y"]]}]})
    rows = payloads.result_set(frame, "payload", 0, {"B": "string", "A": "long", "C": "double"}).orderBy("B").collect()
    assert [tuple(r) for r in rows] == [("x", 1, None), ("y", None, None)]
    assert payloads.result_set(frame, "payload", 1, {"A": "long"}).count() == 0


def test_scoreboard_spellings_and_days(spark):
    games = [
        {"gameId": "001", "homeTeam": {"teamId": 1}, "awayTeam": {"teamId": "2"}, "gameStatusText": "Final"},
        {"GAME_ID": "002", "homeTeamId": "3", "visitorTeamId": "TBD", "status": ""},
    ]
    frame = payload(spark, {"scoreboard": {"gameDate": "2024-01-05", "games": games}})
    rows = payloads.scoreboard(frame, "payload", "2024-01-05").orderBy("game_id").collect()
    assert [tuple(r)[1:] for r in rows] == [("001", 1, 2, "Final"), ("002", 3, None, "Scheduled")]
    assert payloads.scoreboard(frame, "payload", "2024-01-06").count() == 0


def test_schedule_prefix_and_manual_games(spark):
    game = lambda d: {"gameId": d, "gameDateEst": f"{d}T00:00:00Z", "homeTeam": {"teamId": 1}, "awayTeam": {"teamId": 2}}
    frame = payload(spark, {"leagueSchedule": {"gameDates": [{"games": [game("2024-01-05")]}, {"games": [game("2024-02-05")]}]}})
    assert [r.game_id for r in payloads.season_schedule(frame, "payload", "2024-01").collect()] == ["2024-01-05"]
    manual = payload(spark, [{"home_id": 5, "away_team_id": 6}])
    row = payloads.manual_games(manual, "payload", F.lit("2024-03-01").cast("date")).first()
    assert (row.home_team_id, row.away_team_id, row.game_status, row.game_date) == (5, 6, "Scheduled", dt.date(2024, 3, 1))


def test_streak_text(spark):
    base = dict(WINS="3", LOSSES="1", WinPCT=".75", PlayoffRank="2", LeagueRank=None, ConferenceGamesBack=None)
    texts = ["W 5", "L 3", "broken", None]
    frame = spark.createDataFrame([dict(base, TeamID=str(i), strCurrentStreak=t) for i, t in enumerate(texts)], "TeamID string, WINS string, LOSSES string, WinPCT string, PlayoffRank string, LeagueRank string, ConferenceGamesBack string, strCurrentStreak string")
    rows = payloads.live_standings(frame).orderBy("team_id").collect()
    assert [r.streak for r in rows] == [5, -3, 0, 0]
    assert (rows[0].league_rank, rows[0].games_back) == (2, 0.0)


@pytest.fixture
def games(log):
    return log.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.GAME_LOG])


def test_log_round_trip_and_season_overwrite(spark, games, tmp_path):
    path = str(tmp_path / "log")
    assert files.read_game_log(spark, path) is None
    files.write_by_season(games, path, replace_all=True)
    before = {r.season: r["count"] for r in files.read_game_log(spark, path).groupBy("season").count().collect()}
    files.write_by_season(games.filter("season = '1996-97'").limit(3), path)
    after = {r.season: r["count"] for r in files.read_game_log(spark, path).groupBy("season").count().collect()}
    assert after == before | {"1996-97": 3}
    assert str(files.high_water_mark(files.read_game_log(spark, path))) == str(games.agg(F.max("game_date")).first()[0])


def test_csv_seasons_are_tagged(spark, games, tmp_path):
    paths = {}
    for season in ("1995-96", "1996-97"):
        paths[season] = str(tmp_path / season)
        games.filter(F.col("season") == season).withColumn("season", F.lit("?")).write.csv(paths[season], header=True)
    merged = files.read_seasons(spark, paths)
    assert merged.exceptAll(games.filter("season in ('1995-96', '1996-97')")).count() == 0
    assert merged.groupBy("season").count().count() == 2


def test_history_append_drops_known_rows(spark, tmp_path):
    path = str(tmp_path / "history")
    row = lambda home: (dt.date(2024, 1, 1), "A", home, "A", None, 0.5, 0.2, 0.9, "GOOD", None)
    frame = lambda *homes: spark.createDataFrame([row(h) for h in homes], schemas.HISTORY)
    files.append_history(frame("H1"), path)
    files.append_history(frame("H1", "H2"), path)
    files.append_history(frame("H1", "H2"), path)
    assert sorted(r.home_team for r in spark.read.parquet(path).collect()) == ["H1", "H2"]


def test_odds_files(spark, tmp_path):
    quote = {"id": "1", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "b", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 1.5}]}]}]}
    (tmp_path / "live.json").write_text(json.dumps(quote))
    (tmp_path / "past.json").write_text(json.dumps({"timestamp": "t", "data": [quote, quote]}))
    assert files.read_odds(spark, str(tmp_path / "live.json")).first().bookmakers[0].markets[0].outcomes[0].price == 1.5
    assert files.read_odds_snapshots(spark, str(tmp_path / "past.json")).count() == 2


@pytest.fixture
def landings(log, tmp_path):
    """Contests of two seasons, a file for each of three spans of days, and a way to land them."""
    from paircast.operators.games import valid_contests

    contests = valid_contests(log).filter("game_date between date'1995-03-01' and date'1996-02-01'")
    narrow = contests.select(
        F.lit("all").alias("pool"), "game_date", "game_id", "home_team_id", "away_team_id",
        (F.col("home_wl") == "W").cast("int").alias("home_won"), "season",
    )
    assert narrow.select("season").distinct().count() > 1
    cuts = ["1995-03-01", "1995-07-01", "1995-11-15", "1996-02-02"]

    def land(i):
        part = narrow.filter((F.col("game_date") >= cuts[i]) & (F.col("game_date") < cuts[i + 1])).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))

    return contests, narrow, cuts, land, str(tmp_path / "in")


def _by_game(rated):
    return {r.game_id: (r.elo_home, r.elo_away, r.elo_prob_home) for r in rated.collect()}


def test_rating_stream_over_batches_equals_the_batch(spark, landings):
    """Daily files, several micro-batches: state must carry the ratings."""
    from paircast.operators.ratings import elo_ratings

    contests, narrow, _, land, folder = landings
    for i in range(3):
        land(i)
    source = streams.file_stream(spark, folder, narrow.schema, files_per_batch=1)
    with streams.keyed_state(spark):
        streamed = _by_game(streams.drain(streams.rate_stream(source), "t"))
    assert streamed == _by_game(elo_ratings(contests))


def test_rating_stream_goes_on_from_a_snapshot_and_after_restarts(spark, landings, tmp_path):
    from paircast.operators.ratings import elo_current, elo_ratings
    from paircast.sources.files import read_ratings, write_ratings

    contests, narrow, cuts, land, folder = landings
    earlier, later = contests.filter(F.col("game_date") < cuts[1]), contests.filter(F.col("game_date") >= cuts[1])
    write_ratings(elo_current(earlier), f"{tmp_path}/ratings", cuts[1])
    snapshot = read_ratings(spark, f"{tmp_path}/ratings")
    whole = _by_game(elo_ratings(contests))
    want = {r.game_id: whole[r.game_id] for r in later.select("game_id").collect()}
    assert _by_game(elo_ratings(later, snapshot=snapshot, block_contests=40)) == want
    for i in (1, 2):
        land(i)
        source = streams.file_stream(spark, folder, narrow.schema)
        with streams.keyed_state(spark):
            streams.run_available(streams.rate_stream(source, snapshot), f"{tmp_path}/out")
    assert _by_game(spark.read.parquet(f"{tmp_path}/out")) == want
    newest = lambda rows: {r.team_id: (r.rating, r.season) for r in rows.collect()}
    assert newest(elo_current(later, snapshot=snapshot)) == newest(elo_current(contests))
    assert newest(elo_current(contests.limit(0), snapshot=snapshot)) == newest(snapshot)


def test_history_flags_with_decimals(spark, tmp_path):
    from paircast.operators import stats
    from paircast.operators.history import backfill
    from paircast.sources.files import read_history

    (tmp_path / "history.csv").write_text(
        "date,away_team,home_team,prediction,winner,confidence,home_win_prob,model_agreement,tier,correct\n"
        "2024-01-01,A,B,B,B,0.5,0.75,0.9,EXCELLENT,1.0\n2024-01-01,C,D,C,D,0.4,0.3,0.9,STRONG,0.0\n2024-01-02,A,D,A,,0.4,0.3,0.9,STRONG,\n"
    )
    history = read_history(spark, str(tmp_path / "history.csv"))
    row = stats.overall(history).first()
    assert (row.total, row.correct, row.pending) == (2, 1, 1)
    results = spark.createDataFrame([("A", "D", "D")], "away_team string, home_team string, winner string").withColumn("date", F.lit("2024-01-02").cast("date"))
    filled = {(r.away_team, r.home_team): r.correct for r in backfill(history, results).collect()}
    assert filled == {("A", "B"): 1, ("C", "D"): 0, ("A", "D"): 0}


def test_null_status_beside_its_text(spark):
    from paircast.operators.schedule import scoreboard_status, top_statuses

    board = spark.createDataFrame([(1, None), (1, "None"), (1, "Final")], "game_date int, game_status string")
    row = scoreboard_status(board).first()
    assert row.status_counts == {"None": 2, "Final": 1} and not row.all_final and row.any_final
    assert [r.game_status for r in top_statuses(board, 1).collect()] == ["None"]


def test_ratings_keep_text_ids_and_go_on_from_a_snapshot(spark, tmp_path):
    from paircast.operators.ratings import elo_current, elo_ratings
    from paircast.sources.files import read_ratings, write_ratings

    rows = [("0022300001", "2024-01-01", 1, 2, "W"), ("0022300002", "2024-01-02", 2, 1, "W")]
    contests = spark.createDataFrame(rows, "game_id string, day string, home_team_id long, away_team_id long, home_wl string")
    contests = contests.select("*", F.col("day").cast("date").alias("game_date"), F.lit("2023-24").alias("season"))
    assert {r.game_id for r in elo_ratings(contests).collect()} == {"0022300001", "0022300002"}
    path = f"{tmp_path}/ratings"
    assert read_ratings(spark, path) is None
    write_ratings(elo_current(contests), path, "2024-01-02")
    assert read_ratings(spark, path, "2024-01-02").count() == 2 and read_ratings(spark, path, "2024-01-01").count() == 0


def test_odds_cache(spark, tmp_path):
    from paircast.sources.files import append_odds, read_odds_features

    path = f"{tmp_path}/odds"
    assert read_odds_features(spark, path) is None
    rows = spark.createDataFrame([("2024-01-01", 1.5), ("2024-01-02", 1.7)], "game_date string, home_avg_odds double")
    append_odds(rows, path)
    assert [str(r.game_date) for r in read_odds_features(spark, path).orderBy("game_date").collect()] == ["2024-01-01", "2024-01-02"]


def test_scans_open_the_asked_seasons_only(spark, log, tmp_path):
    from paircast.sources.files import read_by_season, write_by_season, write_table

    path = f"{tmp_path}/seasons"
    write_by_season(log, path, replace_all=True)
    read = lambda **asked: read_by_season(spark, path, log.schema, **asked)
    plan = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def same(got, want):
        assert got.columns == want.columns and got.count() > 0
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    asked = read(season="1996-97")
    same(asked, log.filter("season = '1996-97'"))
    assert "PartitionFilters: [isnotnull(season#" in plan(asked) and "= 1996-97)" in plan(asked)
    same(read(exclude="1996-97"), log.filter("season <> '1996-97'"))
    days = read(since="1996-08-20", until="1996-12-10")
    same(days, log.filter("game_date between date'1996-08-20' and date'1996-12-10'"))
    shown = next(line for line in plan(days).splitlines() if "PartitionFilters" in line)
    assert ">= 1995-96" in shown or ">= 1996-97" in shown
    assert "<= 1996-97" in shown
    write_table(log.select("season").distinct().withColumn("asked", (F.col("season") > "1996").cast("int")), f"{tmp_path}/dim")
    among = read(among=spark.read.parquet(f"{tmp_path}/dim").filter("asked = 1"))
    same(among, log.filter("season > '1996'"))
    assert "dynamicpruning" in plan(among)


@pytest.mark.parametrize("expiry", ["0 seconds", "1 day"])
def test_late_repeats_are_dropped_after_their_state_expired(spark, tmp_path, expiry):
    schema = "code string, n int"
    landings = [[("a", 1), ("a", 1), ("b", 1), (None, 1)], [("a", 1), ("c", 1), (None, 1)], [("b", 2), ("b", 1), ("c", 1)]]
    into, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in landings:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(into)
        known = streams.written_so_far(spark, out, frame.schema)
        streams.run_available(streams.first_deliveries(streams.file_stream(spark, into, frame.schema), ["code", "n"], known, expiry), out)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=str) == sorted({row for rows in landings for row in rows}, key=str)
