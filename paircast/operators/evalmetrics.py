"""Evaluation of scored contests as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paircast.functions.prediction import predicted_label
from paircast.operators.sequence import exact_median


def accuracy(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return scored.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"))


def confusion_matrix(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return scored.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def _ratio(part, whole):
    """A ratio that is 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)


def classification_report(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted.

    Works on the four confusion counts, which one partial aggregate yields.
    """
    cells = confusion_matrix(scored, label, predicted).agg(
        *[
            F.coalesce(F.sum(F.when((F.col(label) == y) & (F.col(predicted) == p), F.col("n"))), F.lit(0)).alias(f"c{y}{p}")
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    rows = []
    for value, name in ((0, "Away Win"), (1, "Home Win")):
        hit = F.col(f"c{value}{value}")
        said = F.col(f"c0{value}") + F.col(f"c1{value}")
        there = F.col(f"c{value}0") + F.col(f"c{value}1")
        rows.append(
            F.struct(
                F.lit(name).alias("class_name"),
                _ratio(hit, said).alias("precision"),
                _ratio(hit, there).alias("recall"),
                _ratio(2 * hit, said + there).alias("f1"),
                there.alias("support"),
            )
        )
    classes = cells.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    metrics = ("precision", "recall", "f1")
    totals = classes.agg(
        F.struct(
            F.lit("macro avg").alias("class_name"),
            *[F.avg(m).alias(m) for m in metrics],
            F.sum("support").alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("class_name"),
            *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics],
            F.sum("support").alias("support"),
        ).alias("weighted"),
    )
    averages = totals.select(F.explode(F.array("macro", "weighted")).alias("_r")).select("_r.*")
    return classes.unionByName(averages)


def calibration_bins(scored: DataFrame, label: str = "label", prob: str = "prob", bins: int = 10) -> DataFrame:
    """Counts and means per bin (low, high]; a probability of 0 is in no bin."""
    edges = [i / bins for i in range(bins + 1)]
    inside = [F.when((F.col(prob) > lo) & (F.col(prob) <= hi), i) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return (
        scored.withColumn("bin", F.coalesce(*inside))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("observed"), F.avg(prob).alias("predicted"))
    )


def calibration_error(scored: DataFrame, label: str = "label", prob: str = "prob", bins: int = 10) -> DataFrame:
    table = calibration_bins(scored, label, prob, bins)
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("observed") - F.col("predicted"))).otherwise(0.0)
    return table.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def probability_summary(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Mean, population deviation, range and the exact median."""
    moments = scored.agg(
        F.avg(prob).alias("mean"),
        F.stddev_pop(prob).alias("std"),
        F.min(prob).alias("min"),
        F.max(prob).alias("max"),
    )
    median = exact_median(scored, prob)
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(moments).join(one(median), "_one").drop("_one")


def model_accuracies(scored: DataFrame, models: list[str], label: str = "label") -> DataFrame:
    """Accuracy per model column, from one aggregate that is then unpivoted."""
    hit = lambda m: F.avg((predicted_label(F.col(m)) == F.col(label)).cast("int"))
    wide = scored.agg(*[hit(m).alias(m) for m in models])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("accuracy")) for m in models])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def with_best_model(accuracies: DataFrame) -> DataFrame:
    """Add the average over the models and mark the best one."""
    everything = Window.partitionBy(F.lit(0))  # one row per model
    first_best = Window.partitionBy(F.lit(0)).orderBy(F.desc("accuracy"), "model")
    return accuracies.withColumn("average", F.avg("accuracy").over(everything)).withColumn(
        "is_best", F.row_number().over(first_best) == 1
    )


def with_class_weights(rows: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
    """Balanced weights n / (classes * n_class), from a table with one row per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    weights = counts.select(
        label, (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias(name)
    )
    return rows.join(weights, label)
