"""Evaluation metrics over scored contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.functions import prediction as P
from paircast.operators import evalmetrics as E
from paircast.workload import tables as T
from paircast.workload.registry import i8, query, r6, tidy

PROBS_SQL = "list_value(p1, p2, p3, p4)"


def _judged(spark, sf_dir):
    scored = T.scored_contests(spark, sf_dir)
    return scored.withColumn("prob", F.col("p1")).withColumn("predicted", P.predicted_label(F.col("p1")))


JUDGED_SQL = f"{T.SCORED_SQL}, judged AS (SELECT *, p1 AS prob, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS predicted FROM scored)"


@query("accuracy", f"WITH {JUDGED_SQL} SELECT {r6('avg(CASE WHEN label = predicted THEN 1 ELSE 0 END)', 'accuracy')} FROM judged")
def accuracy(spark, sf_dir):
    return tidy(E.accuracy(_judged(spark, sf_dir)))


@query("confusion_matrix", f"WITH {JUDGED_SQL} SELECT {i8('label')}, {i8('predicted')}, count(*) AS n FROM judged GROUP BY label, predicted")
def confusion_matrix(spark, sf_dir):
    return tidy(E.confusion_matrix(_judged(spark, sf_dir)))


@query(
    "classification_report",
    f"""WITH {JUDGED_SQL}, k AS (
      SELECT c.v, c.class_name, count(*) FILTER (WHERE label = v AND predicted = v) AS hit,
             count(*) FILTER (WHERE predicted = v) AS said, count(*) FILTER (WHERE label = v) AS support
      FROM judged, (VALUES (0, 'Away Win'), (1, 'Home Win')) c(v, class_name) GROUP BY ALL),
    m AS (SELECT class_name, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
          CASE WHEN said + support > 0 THEN 2 * hit / (said + support) ELSE 0 END AS f1, support FROM k)
    SELECT class_name, {r6('precision')}, {r6('recall')}, {r6('f1')}, {i8('support')} FROM m
    UNION ALL SELECT 'macro avg', {r6('avg(precision)', 'precision')}, {r6('avg(recall)', 'recall')}, {r6('avg(f1)', 'f1')}, {i8('sum(support)', 'support')} FROM m
    UNION ALL SELECT 'weighted avg', {r6('sum(precision * support) / sum(support)', 'precision')}, {r6('sum(recall * support) / sum(support)', 'recall')},
      {r6('sum(f1 * support) / sum(support)', 'f1')}, {i8('sum(support)', 'support')} FROM m""",
)
def classification_report(spark, sf_dir):
    return tidy(E.classification_report(_judged(spark, sf_dir)))


# Calibration and class counts also run on the label table.
LABELED_SQL = """labeled AS (SELECT doc_id, quality AS label, (doc_id * 7919 % 1000 + 1) / 1001 AS prob FROM labels)"""


def _labeled(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.col("quality").alias("label"), ((F.col("doc_id") * 7919 % 1000 + 1) / 1001).alias("prob"))


_ECE = """bins AS (SELECT coalesce({cases}) AS bin, label, prob FROM {rows}),
per AS (SELECT bin, count(*) AS n, avg(label) AS observed, avg(prob) AS predicted FROM bins GROUP BY bin)
SELECT """ + r6("sum(CASE WHEN bin IS NOT NULL THEN n * abs(observed - predicted) ELSE 0 END) / sum(n)", "ece") + " FROM per"
_CASES = ", ".join(f"CASE WHEN prob > CAST({i / 10} AS DOUBLE) AND prob <= CAST({(i + 1) / 10} AS DOUBLE) THEN {i} END" for i in range(10))


@query("ece", f"WITH {LABELED_SQL}, {_ECE.format(cases=_CASES, rows='labeled')}")
def ece(spark, sf_dir):
    return tidy(E.calibration_error(_labeled(spark, sf_dir)))


@query("ece_contests", f"WITH {JUDGED_SQL}, {_ECE.format(cases=_CASES, rows='judged')}")
def ece_contests(spark, sf_dir):
    return tidy(E.calibration_error(_judged(spark, sf_dir)))


@query(
    "prob_summary",
    f"WITH {JUDGED_SQL} SELECT {r6('avg(prob)', 'mean')}, {r6('stddev_pop(prob)', 'std')}, {r6('min(prob)', 'min')}, {r6('max(prob)', 'max')}, {r6('median(prob)', 'median')} FROM judged",
)
def prob_summary(spark, sf_dir):
    return tidy(E.probability_summary(_judged(spark, sf_dir)))


_MODEL_UNION = " UNION ALL ".join(f"SELECT '{m}' AS model, avg(CASE WHEN (p > 0.5) = (label = 1) THEN 1 ELSE 0 END) AS accuracy FROM (SELECT {m} AS p, label FROM scored)" for m in T.MODELS)


@query(
    "model_accuracy",
    f"""WITH {T.SCORED_SQL}, a AS ({_MODEL_UNION})
    SELECT model, {r6('accuracy')}, {r6('avg(accuracy) OVER ()', 'average')}, row_number() OVER (ORDER BY accuracy DESC, model) = 1 AS is_best FROM a""",
)
def model_accuracy(spark, sf_dir):
    return tidy(E.with_best_model(E.model_accuracies(T.scored_contests(spark, sf_dir), list(T.MODELS))))


def _array_query(name: str, fn, sql: str):
    @query(name, f"WITH {T.SCORED_SQL} SELECT {i8('game_id')}, {sql} FROM scored")
    def run(spark, sf_dir):
        return tidy(T.scored_contests(spark, sf_dir).select("game_id", fn(F.array(*T.MODELS)).alias(name)))


WEIGHTS = [0.4, 0.3, 0.2, 0.3]
_array_query("ensemble_avg", P.array_mean, r6("(p1 + p2 + p3 + p4) / 4", "ensemble_avg"))
_array_query("ensemble_weighted", lambda a: P.weighted_mean(a, WEIGHTS), r6("(0.4 * p1 + 0.3 * p2 + 0.2 * p3 + 0.3 * p4) / CAST(1.2 AS DOUBLE)", "ensemble_weighted"))
_array_query("model_agreement", P.model_agreement, r6(f"1 - list_aggregate({PROBS_SQL}, 'stddev_pop')", "model_agreement"))
_VOTES = " + ".join(f"CASE WHEN {m} > 0.5 THEN 1 ELSE 0 END" for m in T.MODELS)
_array_query(
    "majority_vote",
    lambda a: P.majority_vote(F.transform(a, lambda p: F.when(p > 0.5, 1.0).otherwise(0.0))),
    i8(f"CASE WHEN ({_VOTES}) / 4 >= 0.5 THEN 1 ELSE 0 END", "majority_vote"),
)
_array_query("single_model_predict", lambda a: P.predicted_side(a[1]), "CASE WHEN p2 > 0.5 THEN 'HOME' ELSE 'AWAY' END AS single_model_predict")


@query(
    "class_weights",
    f"""WITH {LABELED_SQL}, c AS (SELECT label, count(*) AS k FROM labeled GROUP BY label)
    SELECT {i8('doc_id')}, {i8('label')}, {r6('(SELECT sum(k) FROM c) / ((SELECT count(*) FROM c) * c.k)', 'class_weight')} FROM labeled JOIN c USING (label)""",
)
def class_weights(spark, sf_dir):
    return tidy(E.with_class_weights(_labeled(spark, sf_dir)), "doc_id", "label", "class_weight")
