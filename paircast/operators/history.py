"""Prediction history: rows to save, new rows, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paircast.functions.prediction import confidence_tier
from paircast.operators.sequence import with_sequence

KEY = ["date", "away_team", "home_team"]


def is_completed(column: str = "correct") -> Column:
    """A result is missing when it is null or an empty text."""
    value = F.col(column).cast("string")
    return value.isNotNull() & (value != "")


def as_flag(column: str = "correct") -> Column:
    """0 or 1 from a number or its text, with or without decimals."""
    return F.expr(f"try_cast(try_cast({column} as double) as int)")


def with_numbers(history: DataFrame) -> DataFrame:
    """Numeric columns from text; what is no number is missing."""
    names = [c for c in ("confidence", "home_win_prob", "model_agreement") if c in history.columns]
    return history.withColumns({c: F.expr(f"try_cast({c} as double)") for c in names})


def completed(history: DataFrame) -> DataFrame:
    """Finished predictions with numeric columns."""
    return with_numbers(history.filter(is_completed())).withColumn("correct", as_flag())


def pending(history: DataFrame) -> DataFrame:
    return history.filter(~is_completed())


def history_rows(predictions: DataFrame) -> DataFrame:
    """Predictions in the history layout; the tier is taken before rounding."""
    return predictions.select(
        "date",
        "away_team",
        "home_team",
        F.col("predicted_winner").alias("prediction"),
        F.lit(None).cast("string").alias("winner"),
        F.bround("confidence", 3).alias("confidence"),
        F.bround("home_win_prob", 3).alias("home_win_prob"),
        F.bround("model_agreement", 3).alias("model_agreement"),
        confidence_tier(F.col("confidence")).alias("tier"),
        F.lit(None).cast("int").alias("correct"),
    )


def new_rows(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows whose (date, away, home) is not in the history yet."""
    return rows.join(history.select(*KEY).distinct(), KEY, "left_anti")


def backfill(history: DataFrame, results: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Set winner and correctness where a result exists; running it twice changes nothing.

    Only the given dates are touched (all dates with pending rows by default).
    """
    if dates is None:
        dates = history.filter(~is_completed("winner")).select("date").distinct()
    known = results.groupBy(*KEY).agg(F.max("winner").alias("_winner"))
    touched = dates.select("date").distinct().withColumn("_touched", F.lit(True))
    joined = history.join(known, KEY, "left").join(touched, "date", "left")
    found = F.col("_touched") & F.col("_winner").isNotNull()
    return (
        joined.withColumn("correct", F.when(found, (F.col("prediction") == F.col("_winner")).cast("int")).otherwise(as_flag()))
        .withColumn("winner", F.when(found, F.col("_winner")).otherwise(F.col("winner")))
        .select(*history.columns)
    )


def ranked_by_confidence(predictions: DataFrame, day: str = "game_date", key: str = "game_id") -> DataFrame:
    """Add `place` within a day, most confident first.

    Bands of confidence are the chunks of the order, so a day with very many
    predictions is ranked by many tasks.
    """
    banded = predictions.withColumn("_band", -F.floor(F.col("confidence") * 1000))
    return with_sequence(banded, [day], "_band", [F.desc("confidence"), key], "place").drop("_band")


def tier_picks(predictions: DataFrame, low: float = 0.30) -> DataFrame:
    return predictions.filter(F.col("confidence") >= low)


def save_gate(predictions: DataFrame, all_finished: Column, day: Column, today: Column) -> DataFrame:
    """Nothing is saved for a board that is all final and not of today."""
    return predictions.filter(~(all_finished & (day != today)))
