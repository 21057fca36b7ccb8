"""Streams, each drained once over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.operators.games import valid_contests
from paircast.operators.ratings import elo_current, elo_ratings
from paircast.session import scratch_path, stored
from paircast.sources.files import read_ratings, write_ratings
from paircast.streaming import streams as S
from paircast.workload import tables as T
from paircast.workload.contest_queries import ELO_SQL
from paircast.workload.registry import i8, query, r6, tidy
from paircast.workload.schedule_queries import _LIVE, _status, live_board


def _table_stream(spark, sf_dir, name):
    schema = T.table(spark, sf_dir, name).schema
    return S.file_stream(spark, sf_dir, schema, f"{name}.parquet")


def _staged(df, label):
    """Rows landed as files, the way a stream source delivers them."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return S.file_stream(df.sparkSession, path, df.schema)


@query("stream_dedupe", f"SELECT DISTINCT {i8('l_orderkey')}, l_linestatus FROM lineitem")
def stream_dedupe(spark, sf_dir):
    """Line items in three landings with a run after each; many keys come again in a later landing."""
    lines = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.col("l_linenumber").alias("_line"))
    landed, out = scratch_path(spark, "deliveries"), scratch_path(spark, "first")
    rows = lines.select("l_orderkey", "l_linestatus")
    for turn in range(3):
        lines.filter(F.pmod("_line", F.lit(3)) == turn).select(rows.columns).write.mode("append").parquet(landed)
        stream = S.file_stream(spark, landed, rows.schema)
        S.run_available(S.first_deliveries(stream, rows.columns, S.written_so_far(spark, out, rows.schema)), out)
    return tidy(spark.read.schema(rows.schema).parquet(out))


@query(
    "stream_status",
    f"WITH board AS (SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, CASE o_orderkey % 4 WHEN 0 THEN 'Final' WHEN 1 THEN 'FINAL/OT' WHEN 2 THEN '7:30 pm ET' END AS game_status FROM orders) "
    f"SELECT {i8('game_id')}, game_date, {_LIVE} AS game_status FROM board",
)
def stream_status(spark, sf_dir):
    shape = lambda rows: rows.select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date")).withColumn("game_status", _status())
    final = live_board(shape(T.table(spark, sf_dir, "orders"))).withColumn("polled_at", F.lit(2))
    earlier = final.withColumn("live_status", F.lit("Pregame")).withColumn("polled_at", F.lit(1))
    overlaid = S.live_overlay(shape(_table_stream(spark, sf_dir, "orders")), final.unionByName(earlier))
    return tidy(S.drain(overlaid, "status"), "game_id", "game_date", "game_status")


@query(
    "stream_elo",
    f"WITH RECURSIVE {ELO_SQL} SELECT season AS pool, {i8('game_id')}, {r6('elo_home')}, {r6('elo_away')}, {r6('elo_home - elo_away', 'elo_diff')}, {r6('elo_prob_home')} FROM elo",
)
def stream_elo(spark, sf_dir):
    """Rated in a batch up to a day, stored, and rated on by a stream that is restarted for every later landing."""
    contests = stored(valid_contests(T.game_log(spark, sf_dir)), "rated-contests")
    first, last = contests.agg(F.min("game_date"), F.max("game_date")).first()
    cuts = [first + (last - first) * i / 4 for i in (1, 2, 3)] + [last]
    earlier = contests.filter(F.col("game_date") <= cuts[0])
    ratings, landed, out = (scratch_path(spark, label) for label in ("ratings", "landed", "rated"))
    write_ratings(elo_current(earlier, pool="season"), ratings, str(cuts[0]))
    narrow = contests.select(
        F.col("season").alias("pool"), "game_date", "game_id", "home_team_id", "away_team_id",
        (F.col("home_wl") == "W").cast("int").alias("home_won"), "season",
    )
    with S.keyed_state(spark):
        for after, until in zip(cuts, cuts[1:]):
            narrow.filter((F.col("game_date") > after) & (F.col("game_date") <= until)).write.mode("append").parquet(landed)
            stream = S.rate_stream(S.file_stream(spark, landed, narrow.schema), read_ratings(spark, ratings))
            S.run_available(stream, out)
    streamed = spark.read.schema(stream.schema).parquet(out)
    return tidy(elo_ratings(earlier, pool="season").unionByName(streamed))


@query(
    "stream_backfill",
    f"WITH {T.HISTORY_SQL} SELECT {i8('game_id')}, prediction, CASE WHEN label = 1 THEN home_team ELSE away_team END AS winner, "
    f"{i8('CASE WHEN prediction = CASE WHEN label = 1 THEN home_team ELSE away_team END THEN 1 ELSE 0 END', 'correct')} "
    "FROM history JOIN (SELECT game_id, label FROM scored) USING (game_id)",
)
def stream_backfill(spark, sf_dir):
    winner = F.when(F.col("label") == 1, F.col("home_team")).otherwise(F.col("away_team"))
    rows = T.predictions(spark, sf_dir)
    at = lambda hour: F.timestamp_add("HOUR", F.lit(hour), F.col("game_date").cast("timestamp"))
    predictions = rows.select("game_id", F.col("predicted_winner").alias("prediction"), at(12).alias("predicted_at"))
    results = rows.select("game_id", winner.alias("winner"), at(30).alias("finished_at"))
    joined = S.backfill_stream(_staged(predictions, "predictions"), _staged(results, "results"))
    return tidy(S.drain(joined, "backfill"), "game_id", "prediction", "winner", "correct")
