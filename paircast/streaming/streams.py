"""Structured Streaming forms of the incremental operators.

State is keyed, bounded by a watermark or by the number of rated teams, and
kept with the sink's progress below the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paircast.operators.games import overlay_status
from paircast.operators.ratings import rated_schema, replay
from paircast.session import scratch_path
from paircast.sources.files import exists


def file_stream(spark: SparkSession, path: str, schema: T.StructType, name_filter: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over parquet files as they land."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str) -> None:
    """Append what a stream makes of everything available; a later call goes on from where this one ended."""
    running = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    run_available(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


def dedupe(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeated deliveries of a key that arrive within the watermark delay."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def first_deliveries(rows: DataFrame, keys: list[str], written: DataFrame, expiry: str = "1 day") -> DataFrame:
    """Rows whose key was delivered neither before in this run nor in earlier runs.

    Keys of this run are state, which expires with the time of arrival, so its
    size is that of the deliveries of one expiry, whatever their event times,
    and no row is too late. Keys of earlier runs are looked up in what those
    wrote (`written`). A run over what is available must therefore be shorter
    than the expiry. Null is a key like others; of rows with one key any may stay.
    """
    arrived = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", expiry)
    fresh = arrived.dropDuplicatesWithinWatermark(keys).drop("_arrived")
    known = written.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
    return fresh.join(known, same, "left_anti")


def written_so_far(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """What earlier runs wrote to a table, nothing before the first one."""
    reader = spark.read.schema(schema)
    return reader.parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)


def live_overlay(board: DataFrame, live: DataFrame) -> DataFrame:
    """Status of a polled board: a stream of scheduled rows against the live table.

    The live table keeps one row per game and day, its newest status.
    """
    newest = live.groupBy("game_id", "board_date").agg(F.max_by("live_status", "polled_at").alias("live_status"))
    return overlay_status(board, newest)


class _Ratings(StatefulProcessor):
    """Ratings of one pool, kept team by team: a batch reads and writes the teams it meets.

    `turn` counts the seasons that began, so a season's start touches no team
    until its next contest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._teams = handle.getMapState("teams", "team_id bigint", "rating double, turn bigint")
        self._season = handle.getValueState("season", "season string, turn bigint")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self._teams.updateValue((row.team_id,), (row.rating, 0))
            self._season.update((row.season, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["game_date", "game_id"])
        season, turn = self._season.get() if self._season.exists() else (None, 0)
        turns = []
        for current in batch["season"]:
            current = None if pd.isna(current) else current
            turn += season is not None and current != season
            season = current
            turns.append(turn)
        met = [int(team) for team in pd.unique(batch[["home_team_id", "away_team_id"]].to_numpy().ravel())]
        ratings = {team: tuple(self._teams.getValue((team,))) for team in met if self._teams.containsKey((team,))}
        rated = replay(batch.assign(turn=turns), ratings)
        for team in met:
            rating, since = ratings[team]
            self._teams.updateValue((team,), (float(rating), int(since)))
        self._season.update((season, int(turn)))
        yield rated

    def close(self) -> None:
        pass


#: State kept team by team needs the store that holds single keys. Pools are many small
#: stores, which would each take 4 MB of disk in advance on every executor.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def rate_stream(contests: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Ratings carried across micro-batches and restarts, from a stored snapshot on if one is given.

    Batches must arrive in time order, as a file stream of daily files does;
    inside a batch rows are sorted. A task holds a pool's part of a batch, which
    `files_per_batch` of the source bounds, and the teams met in it. The
    snapshot is read by the first batch only. The session must keep state by
    key, see `keyed_state`.
    """
    initial = None if snapshot is None else snapshot.select("pool", "team_id", "rating", "season").groupBy("pool")
    return contests.groupBy("pool").transformWithStateInPandas(_Ratings(), rated_schema(contests), "append", "none", initial)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store by key; a stream must be restarted in it as well."""
    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def backfill_stream(predictions: DataFrame, results: DataFrame, delay: str = "7 days", within: str | None = None) -> DataFrame:
    """Predictions joined to results that arrive later, both under a watermark.

    With `within`, an interval, predictions wait that long and are then dropped
    from the state; without it every pending prediction waits for its result.
    """
    left = predictions.withWatermark("predicted_at", delay).alias("p")
    right = results.withWatermark("finished_at", delay).alias("r")
    same = (F.col("p.game_id") == F.col("r.game_id")) & (F.col("r.finished_at") >= F.col("p.predicted_at"))
    if within is not None:
        same = same & (F.col("r.finished_at") <= F.col("p.predicted_at") + F.expr(f"interval {within}"))
    correct = (F.col("p.prediction") == F.col("r.winner")).cast("int")
    return left.join(right, same).select("p.game_id", "p.prediction", "r.winner", correct.alias("correct"))
