"""Boards of a day: status and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def is_final_text(status: Column) -> Column:
    return F.coalesce(F.lower(status).contains("final"), F.lit(False))


def scoreboard_status(board: DataFrame, day: str = "game_date") -> DataFrame:
    """Per day: games, whether all or any are final, and rows per status text."""
    text = F.coalesce("game_status", F.lit("None"))
    per_status = board.groupBy(day, text.alias("game_status")).agg(F.count(F.lit(1)).alias("n"))
    final = is_final_text(F.col("game_status"))
    return per_status.groupBy(day).agg(
        F.sum("n").alias("n_games"),
        F.bool_and(final).alias("all_final"),
        F.bool_or(final).alias("any_final"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("game_status").alias("status"), "n")))
        ).alias("status_counts"),
    )


def all_finished(board: DataFrame, day: str = "game_date") -> DataFrame:
    """Days on which every game of the board is exactly Final."""
    return board.groupBy(day).agg(
        F.bool_and(F.coalesce(F.col("game_status") == "Final", F.lit(False))).alias("all_finished")
    )


def top_statuses(board: DataFrame, n: int = 3, day: str = "game_date") -> DataFrame:
    """The n most frequent status texts of each day, ties by text."""
    counts = board.groupBy(day, F.coalesce("game_status", F.lit("None")).alias("game_status")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.desc("n"), "game_status"))
    return counts.withColumn("place", place).filter(F.col("place") <= n)
