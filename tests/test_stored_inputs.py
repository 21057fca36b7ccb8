"""What a query reads several times is stored first."""

from __future__ import annotations

import pytest

from paircast.plans import training as M
from paircast.workload import model_queries as Q


@pytest.mark.parametrize("query, module, reader", [("scale_features", Q, "chronological_split"), ("train_logistic", M, "training_rows")])
def test_what_is_read_several_times_is_stored(spark, sf_dir, monkeypatch, query, module, reader):
    class Read(Exception):
        pass

    def seen(rows, *_):
        raise Read(*rows.inputFiles())

    monkeypatch.setattr(module, reader, seen)
    monkeypatch.setattr(Q, "content_key", lambda log: f"not-stored-{query}")
    with pytest.raises(Read) as files:
        getattr(Q, query, None)(spark, sf_dir) if hasattr(Q, query) else Q._prepared(spark, sf_dir)
    assert files.value.args and not any("game-log" in f for f in files.value.args)
