"""Spark ML on the contest table. Fits are checked by their shape and range."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.functions.prediction import predicted_label
from paircast.operators import evalmetrics as E
from paircast.operators.form import form_features
from paircast.operators.games import valid_contests, with_ratios
from paircast.operators.odds import odds_features, odds_keyed
from paircast.operators.preparation import chronological_split, feature_columns, top_features
from paircast.operators.standings import standings_at_date
from paircast.plans import training as M
from paircast.plans.contest_table import contest_columns, contest_table, matched_sides, narrow_log
from paircast.plans.serving import predict_schedule
from paircast.session import shared_dir, stored
from paircast.sources.files import content_key, once
from paircast.workload import tables as T
from paircast.workload.log_queries import FORM_SQL, MEAN_SQL, STD_SQL
from paircast.workload.registry import i8, query, r6, tidy

#: The statistics that the SQL of scale_features needs.
STATS = ("pts", "efg_pct", "tov_pct", "reb")
ALL = tuple(M.DEFAULT_ARCHITECTURES)


def _form(spark, sf_dir, **options):
    return form_features(narrow_log(T.form_log(spark, sf_dir)), ewm=False, derive=with_ratios, **options)


def _folder(spark, sf_dir):
    """The bundle of these tables: training rows, models and their probabilities, made once and read by all queries."""
    return f"{shared_dir(spark).rstrip('/')}/bundle-{content_key(T.game_log(spark, sf_dir))}"


def _prepared(spark, sf_dir):
    def write(path):
        # Stored, since the split reads the table once for its ranks, once for their carries and once for the count.
        contests = stored(contest_table(T.stored_log(spark, sf_dir), T.conference()), "contests")
        M.training_rows(contests).write.parquet(path)

    return spark.read.parquet(once(spark, f"{_folder(spark, sf_dir)}/rows", write)), feature_columns(contest_columns())


def _ensemble(spark, sf_dir, *names):
    """The models with the defaults of plans/training.py."""
    rows, features = _prepared(spark, sf_dir)
    return M.stored_ensemble(rows, features, _folder(spark, sf_dir), list(names))


def _held_out(spark, sf_dir, *names):
    """The test rows with the probability of each model."""
    rows, _ = _prepared(spark, sf_dir)
    held_out = rows.filter("is_test")

    def write(path):
        M.with_model_probs(held_out, _ensemble(spark, sf_dir, *names)).select("game_id", *[f"prob_{n}" for n in names]).write.parquet(path)

    probs = once(spark, f"{_folder(spark, sf_dir)}/probs-{'-'.join(names)}", write)
    return held_out.join(spark.read.parquet(probs), "game_id")


def _scored(names):
    """An ensemble whose probabilities are columns already."""
    return M.Ensemble(list(names), [None] * len(names), feature_columns(contest_columns()))


_SIDE_MEANS = ("home_pts_roll_mean", "away_pts_roll_mean", "home_pts_roll_std", "home_recent_form")
_ROLLED = [f"{s}_roll_{k}" for s in STATS for k in ("mean", "std")]
_SMALL_READY = " AND ".join(f"{c} IS NOT NULL" for c in (*_ROLLED, "win_streak"))
MATCHED_SMALL_SQL = f"""{FORM_SQL},
ready AS (SELECT * FROM form WHERE {_SMALL_READY}),
matched AS (SELECT h.game_id, h.game_date, h.pts_roll_mean AS home_pts_roll_mean, a.pts_roll_mean AS away_pts_roll_mean,
  h.pts_roll_std AS home_pts_roll_std, h.recent_form AS home_recent_form FROM ready h JOIN ready a ON h.game_id = a.game_id AND h.at_home AND NOT a.at_home),
ranked AS (SELECT *, row_number() OVER (ORDER BY game_date, game_id) AS time_rank, count(*) OVER () AS n FROM matched),
split AS (SELECT *, time_rank <= n - CAST(ceil(n * 0.2) AS BIGINT) AS is_train FROM ranked)"""
_z = lambda c: f"({c} - (SELECT avg({c}) FROM split WHERE is_train)) / (SELECT stddev_pop({c}) FROM split WHERE is_train)"


@query("scale_features", f"WITH {MATCHED_SMALL_SQL} SELECT {i8('game_id')}, {', '.join(r6(_z(c), c) for c in _SIDE_MEANS)} FROM split")
def scale_features(spark, sf_dir):
    # Stored, since the split, both passes of the scaler and the result read it.
    sides = stored(matched_sides(_form(spark, sf_dir, stats=STATS)), "matched-sides")
    rows = chronological_split(sides.select("game_id", "game_date", *_SIDE_MEANS))
    fitted = M.fit_scaler(rows.filter("not is_test"), list(_SIDE_MEANS))
    return tidy(M.scaled_columns(rows, fitted, list(_SIDE_MEANS)), "game_id", *_SIDE_MEANS)


def _train_query(name: str, architecture: str):
    @query(name)
    def run(spark, sf_dir):
        scored = _held_out(spark, sf_dir, architecture)
        return tidy(scored.withColumnRenamed(f"prob_{architecture}", "prob"), "game_id", "home_win", "prob")


for _name, _architecture in (
    ("train_gbt", "boosted_trees"),
    ("train_rf", "random_forest"),
    ("train_logistic", "logistic"),
    ("train_mlp", "perceptron"),
):
    _train_query(_name, _architecture)


@query("train_ensemble")
def train_ensemble(spark, sf_dir):
    scored = _held_out(spark, sf_dir, *ALL)
    return tidy(E.with_best_model(E.model_accuracies(scored, _scored(ALL).columns, "home_win")))


@query("evaluate_ensemble")
def evaluate_ensemble(spark, sf_dir):
    scored = M.score(_held_out(spark, sf_dir, *ALL), _scored(ALL))
    judged = scored.withColumn("label", F.col("home_win").cast("int")).withColumn("predicted", predicted_label(F.col("home_win_prob")))
    return tidy(E.classification_report(judged))


def _stacked(spark, sf_dir):
    held_out = _held_out(spark, sf_dir, *ALL)
    return M.score(held_out, M.train_stacking(_scored(ALL), held_out))


@query("stacking")
def stacking(spark, sf_dir):
    held_out = _held_out(spark, sf_dir, *ALL)
    trained = M.train_stacking(_scored(ALL), held_out)
    plain = M.Ensemble(trained.architectures, trained.models, trained.features, meta=trained.meta)
    return tidy(M.score(held_out, plain), "game_id", "home_win", "stacked_prob")


@query("platt")
def platt(spark, sf_dir):
    return tidy(_stacked(spark, sf_dir), "game_id", "home_win", "stacked_prob")


_SCORE = ("game_id", "home_win_prob", "away_win_prob", "prediction_std", "model_agreement", "predicted_side", "confidence", "tier", "stacked_prob")


@query("score_games")
def score_games(spark, sf_dir):
    return tidy(_stacked(spark, sf_dir), *_SCORE)


@query("predict_schedule")
def predictions_of_schedule(spark, sf_dir):
    log = T.game_log(spark, sf_dir)
    quotes = odds_features(T.nested_odds(spark, sf_dir), ["id", "commence_time", "home_team", "away_team"])
    odds = odds_keyed(
        quotes.withColumn("game_date", F.to_date("commence_time")).withColumn("ordinal", F.col("id").cast("long"))
    )
    predicted = predict_schedule(
        T.schedule(spark, sf_dir),
        T.teams(spark, sf_dir),
        _form(spark, sf_dir),
        valid_contests(log),
        standings_at_date(log, "2100-01-01", T.conference()),
        odds,
        _ensemble(spark, sf_dir, *ALL),
    )
    return tidy(predicted, "game_date", "place", "game_id", "home_team", "away_team", "predicted_winner", "home_win_prob", "confidence", "tier", "match_kind")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    _, features = _prepared(spark, sf_dir)
    return tidy(M.feature_importance(_ensemble(spark, sf_dir, "random_forest").models[0], features, spark))


@query("top_features")
def best_features(spark, sf_dir):
    _, features = _prepared(spark, sf_dir)
    ranked = M.feature_importance(_ensemble(spark, sf_dir, "boosted_trees").models[0], features, spark)
    return tidy(top_features(ranked, 10))
