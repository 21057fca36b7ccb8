"""Fits on a seeded table with a known signal."""

import pytest
from pyspark.sql import functions as F

from paircast.operators.evalmetrics import model_accuracies
from paircast.plans import training as M

PARAMS = {
    "boosted_trees": {"rounds": 5, "step": 0.3},
    "random_forest": {"first_trees": 5, "first_depth": 4, "trees": 5, "depth": 4, "top": 2},
    "logistic": {"iterations": 20},
    "perceptron": {"layers": (4,), "iterations": 30},
}
FEATURES = ["home_a", "away_b", "noise"]


@pytest.fixture(scope="module")
def prepared(spark):
    rows = spark.range(400).select(
        F.col("id").alias("game_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("game_date"),
        F.randn(1).alias("home_a"),
        F.randn(2).alias("away_b"),
        F.randn(3).alias("noise"),
    )
    return M.prepare(rows.withColumn("home_win", (F.col("home_a") > F.col("away_b")).cast("int")))


@pytest.fixture(scope="module")
def ensemble(prepared):
    trained = M.train_ensemble(prepared, FEATURES, params=PARAMS)
    return M.train_stacking(trained, prepared.filter("is_test"), iterations=20)


def test_split_and_weights(prepared):
    assert prepared.filter("is_test").count() == 80
    low, high = prepared.filter("not is_test").agg(F.min("sample_weight"), F.max("sample_weight")).first()
    assert (low, high) == (pytest.approx(0.3012, abs=1e-3), pytest.approx(1.0))


def test_scaled_training_rows_are_centred(prepared):
    train = prepared.filter("not is_test")
    scaled = M.scaled_columns(train, M.fit_scaler(train, FEATURES), FEATURES)
    mean, spread = scaled.agg(F.avg("home_a"), F.stddev_pop("home_a")).first()
    assert (mean, spread) == (pytest.approx(0, abs=1e-9), pytest.approx(1))


def test_models_learn_the_signal(prepared, ensemble):
    scored = M.with_model_probs(prepared.filter("is_test"), ensemble)
    accuracies = {r.model: r.accuracy for r in model_accuracies(scored, ensemble.columns, "home_win").collect()}
    assert set(accuracies) == {f"prob_{a}" for a in M.DEFAULT_ARCHITECTURES}
    assert min(accuracies.values()) > 0.7


def test_scores_are_consistent(prepared, ensemble):
    for r in M.score(prepared.filter("is_test"), ensemble).limit(20).collect():
        probs = [r[c] for c in ensemble.columns]
        assert r.home_win_prob == pytest.approx(sum(probs) / len(probs))
        assert r.confidence == pytest.approx(abs(r.home_win_prob - 0.5) * 2)
        assert 0 <= r.stacked_prob <= 1 and r.model_agreement == pytest.approx(1 - r.prediction_std)
        assert r.predicted_side == ("HOME" if r.home_win_prob > 0.5 else "AWAY")


def test_single_model_and_unknown_names(ensemble):
    assert ensemble.single("rf").columns == ["prob_random_forest"]
    with pytest.raises(ValueError, match="not found"):
        ensemble.single("svm")
    with pytest.raises(ValueError, match="unknown architecture"):
        M.trainer("svm")
    M.register_trainer("copy", M.TRAINERS["logistic"])
    assert "copy" in M.available_architectures()
    del M.TRAINERS["copy"]


def test_save_and_load(spark, prepared, ensemble, tmp_path):
    path = str(tmp_path / "ensemble")
    M.save_ensemble(ensemble, spark, path)
    loaded = M.load_ensemble(spark, path)
    rows = prepared.filter("is_test").orderBy("game_id").limit(5)
    pick = lambda e: [r.stacked_prob for r in M.score(rows, e).orderBy("game_id").collect()]
    assert pick(loaded) == pytest.approx(pick(ensemble))


def test_stored_models_are_fitted_once(prepared, tmp_path, monkeypatch):
    first = M.stored_ensemble(prepared, FEATURES, str(tmp_path), ["logistic", "rf"], params=PARAMS)
    monkeypatch.setattr(M, "train_model", lambda *a: pytest.fail("fitted again"))
    again = M.stored_ensemble(prepared, FEATURES, str(tmp_path), ["logistic", "random_forest"], params=PARAMS)
    rows = prepared.filter("is_test")
    pick = lambda e: [tuple(r) for r in M.with_model_probs(rows, e).orderBy("game_id").select(*e.columns).collect()]
    assert pick(again) == pick(first)


def test_groves_make_one_forest(prepared, monkeypatch):
    monkeypatch.setattr(M, "GROVE", 2)
    model = M.train_model(prepared.filter("not is_test"), FEATURES, "rf", params=PARAMS["random_forest"])
    groves = [s.getNumTrees for s in model.stages if hasattr(s, "getNumTrees")]
    assert groves == [2, 2, 1]
    scored = M.with_model_probs(prepared.filter("is_test"), M.Ensemble(["random_forest"], [model], FEATURES))
    assert scored.columns == [*prepared.columns, "prob_random_forest"]
    by_grove = model.transform(prepared.filter("is_test"))
    every = [F.col(f"g{i}")[1] * n / 5 for i, n in enumerate(groves)]
    want = by_grove.select("game_id", *[M.vector_to_array(f"probability_{i}").alias(f"g{i}") for i in range(3)]).select("game_id", sum(every).alias("p"))
    assert scored.join(want, "game_id").filter(F.abs(F.col("p") - F.col("prob_random_forest")) > 1e-12).count() == 0


def test_importances_cover_the_chosen_features(spark, ensemble):
    model = ensemble.models[ensemble.architectures.index("random_forest")]
    rows = M.feature_importance(model, FEATURES, spark).collect()
    assert len(rows) == 2 and sum(r.importance for r in rows) == pytest.approx(1)
