"""The registered model queries fit the whole contest table with the operators' own settings."""

import pytest
from pyspark.ml.feature import VectorSlicer

from paircast.operators.preparation import feature_columns
from paircast.plans import training as M
from paircast.plans.contest_table import contest_columns
from paircast.sources.files import once
from paircast.workload import load_all, model_queries as Q

load_all()


def test_all_models_with_their_defaults_on_all_features(spark, sf_dir, monkeypatch):
    rows, features = Q._prepared(spark, sf_dir)
    assert features == feature_columns(contest_columns()) and len(features) == 112
    used = []
    monkeypatch.setattr(M, "stored_ensemble", lambda rows, names, folder, architectures: used.append((architectures, names)) or Q._scored(architectures))
    monkeypatch.setattr(Q, "predict_schedule", lambda *a: used.append(a[-1].architectures) or rows.limit(0))
    monkeypatch.setattr(Q, "tidy", lambda df, *columns: df)
    Q.predictions_of_schedule(spark, sf_dir)
    assert used == [(M.DEFAULT_ARCHITECTURES, features), M.DEFAULT_ARCHITECTURES]


def test_forest_keeps_its_forty_best_features(spark, sf_dir):
    model = Q._ensemble(spark, sf_dir, "random_forest").models[0]
    slicer = next(s for s in model.stages if isinstance(s, VectorSlicer))
    assert len(slicer.getIndices()) == M.FOREST_PARAMS["top"]
    assert sum(s.getNumTrees for s in model.stages if hasattr(s, "getNumTrees")) == M.FOREST_PARAMS["trees"]


def test_rows_of_the_bundle_are_made_once(spark, sf_dir, monkeypatch):
    first, _ = Q._prepared(spark, sf_dir)
    monkeypatch.setattr(Q, "contest_table", None)
    again, _ = Q._prepared(spark, sf_dir)
    assert again.inputFiles() == first.inputFiles()


def test_a_half_written_result_is_not_taken(spark, tmp_path):
    def broken(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        once(spark, str(tmp_path / "r"), broken)
    path = once(spark, str(tmp_path / "r"), lambda path: spark.range(5).write.parquet(path))
    assert spark.read.parquet(path).count() == 5
    assert once(spark, str(tmp_path / "r"), broken) == path
