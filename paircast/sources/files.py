"""Files and tables: reading with explicit schemas, writing by partition."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paircast.functions.boxscore import season_label
from paircast.operators.history import as_flag, new_rows
from paircast.sources import schemas as S


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def once(spark: SparkSession, folder: str, write: Callable[[str], None]) -> str:
    """The path of a finished result below the folder; `write(path)` makes it if there is none.

    Every attempt has a path of its own and is marked when it is whole, so
    neither a lost driver nor two of them at once leave half a result to others.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_done")
    system = marks.getFileSystem(conf)
    found = sorted(str(status.getPath().getParent()) for status in system.globStatus(marks) or [])
    if found:
        return found[0]
    path = system.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}")).toString()
    write(path)
    system.create(jvm.org.apache.hadoop.fs.Path(f"{path}/_done")).close()
    return path


def content_key(df: DataFrame) -> str:
    """Names the files below a frame: changes with any of their paths, sizes or times."""
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles())  # the contents are not read
    facts = F.xxhash64("path", "length", "modificationTime")
    return files.agg(F.hex(F.bit_xor(facts))).first()[0]


def read_game_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The cached log, or None when there is none."""
    if not exists(spark, path):
        return None
    reader = spark.read.schema(S.GAME_LOG)
    return reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)


def read_seasons(spark: SparkSession, season_paths: dict[str, str], fmt: str = "csv") -> DataFrame:
    """One source per season, tagged with it."""
    parts = []
    for season, path in season_paths.items():
        reader = spark.read.schema(S.GAME_LOG)
        rows = reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)
        parts.append(rows.withColumn("season", F.lit(season)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ODDS).json(path)


def read_odds_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Historical snapshots wrap the quotes of one instant."""
    return spark.read.schema(S.ODDS_SNAPSHOT).json(path).select("timestamp", F.explode("data").alias("_q")).select("timestamp", "_q.*")


def read_history(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Stored predictions; text files write a flag beside gaps as `1.0`, so it is read as text first."""
    if fmt != "csv":
        return spark.read.schema(S.HISTORY).format(fmt).load(path)
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "correct" else f.dataType) for f in S.HISTORY])
    return spark.read.schema(as_text).csv(path, header=True, enforceSchema=False).withColumn("correct", as_flag())


def write_by_season(log: DataFrame, path: str, replace_all: bool = False) -> None:
    """Write the log by season; without `replace_all` only the given seasons change."""
    mode = "static" if replace_all else "dynamic"
    (
        log.hint("rebalance", "season")  # Spark splits and merges tasks by their measured size
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("season")
        .parquet(path)
    )


def read_by_season(
    spark: SparkSession, path: str, schema: T.StructType, season: str | None = None, exclude: str | None = None,
    since: str | None = None, until: str | None = None, among: DataFrame | None = None,
) -> DataFrame:
    """Rows of a log that `write_by_season` stored; files of other seasons are not opened.

    One season, all but one, or the days from `since` to `until`, which also
    name the seasons they lie in; within those files the days are pushed down.
    `among` is a frame of seasons (`season`) whose values prune while the query
    runs. Rows without a season or day are in no answer but the whole log.
    """
    log, label = spark.read.schema(schema).parquet(path).select(schema.names), F.col("season")
    if season is not None:
        log = log.filter(label == season)
    if exclude is not None:
        log = log.filter(label != exclude)
    if since is not None:
        day = F.lit(since).cast("date")
        log = log.filter((label >= season_label(day)) & (F.col("game_date") >= day))
    if until is not None:
        day = F.lit(until).cast("date")
        log = log.filter((label <= season_label(day)) & (F.col("game_date") <= day))
    return log if among is None else log.join(among.select("season").distinct(), "season", "left_semi").select(log.columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def high_water_mark(df: DataFrame, column: str = "game_date"):
    """The newest day of a stored table."""
    return df.agg(F.max(column)).first()[0]


def append_history(rows: DataFrame, path: str) -> None:
    """Append predictions that are not in the history yet, or create it.

    The existing keys are read before anything is written and only new files
    are added, so a repeated call appends nothing.
    """
    spark = rows.sparkSession
    fresh = new_rows(rows, spark.read.schema(S.HISTORY).parquet(path)) if exists(spark, path) else rows
    fresh.write.mode("append").parquet(path)


def append_odds(features: DataFrame, path: str) -> None:
    features.write.mode("append").parquet(path)


def read_odds_features(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached odds features, their day as a date, or None when there are none."""
    if not exists(spark, path):
        return None
    cached = spark.read.parquet(path)
    return cached.withColumn("game_date", F.to_date("game_date"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Evaluation metrics as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_ratings(current: DataFrame, path: str, as_of: str) -> None:
    current.withColumn("as_of", F.lit(as_of).cast("date")).write.mode("overwrite").parquet(path)


def read_ratings(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame | None:
    """A rating snapshot to go on from, or None when there is none (of that day)."""
    if not exists(spark, path):
        return None
    ratings = spark.read.parquet(path)
    if as_of is not None:
        ratings = ratings.filter(F.col("as_of") == F.lit(as_of).cast("date"))
    return ratings
