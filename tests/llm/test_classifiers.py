import zlib

import duckdb
import numpy as np
import pytest
from corpora import awkward, frame

from paircast.llm import language, quality, toxicity
from paircast.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def labels_of(name):
    return dict(duckdb.sql(f"select doc_id, {name} from '{SF}/labels.parquet'").fetchall())


def outside(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_language_query_held_out_accuracy(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op5_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == outside(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_cases(spark):
    docs = frame(spark, awkward(), clash=True)
    rows = language.identify(docs, docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(awkward())
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (11, 12, 13))
    assert got[5].lang_pred == "en" and got[14].lang_pred == "de"
    kept = language.without_rejected(docs, docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (11, 12, 13)").count() == 0
    assert {r.lang_pred for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0


def test_sizes_add_up_over_whole_texts():
    sizer = language.Sizer({"a": b"the of and " * 50, "b": b"der die das " * 50})
    long = "the of and " * 3000
    assert sizer.sizes(long)[0] < sizer.sizes(long)[1]
    assert sizer.sizes(long + "x y z " * 3000)[0] > sizer.sizes(long)[0]


@pytest.mark.parametrize("name, label, modulus, rest, cut", [("op7_quality", "quality", 5, 0, 0.3), ("op8_toxicity", "toxic", 3, 1, 0.7)])
def test_held_out_accuracy(spark, name, label, modulus, rest, cut):
    truth = labels_of(label)
    rows = QUERIES[name](spark, SF).collect()
    assert all(r.held_out == outside(r.doc_id, modulus, rest) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    y = np.array([truth[r.doc_id] for r in held])
    assert np.mean(np.array([r.predicted for r in held]) == y) > 0.93
    s = np.array([r.score for r in held])
    a, b = s[y == 1][:, None], s[y == 0][None]
    assert (a > b).mean() + (a == b).mean() / 2 > (0.95 if label == "quality" else 0.85)


def test_machine_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality._SIZE).astype(np.float32), rng.normal(size=(quality._SIZE, quality.RANK)).astype(np.float32) * 0.1)
    ids, values, begins = quality.features([b"some words some", b"", b"MORE!! 12 | x\nline"])
    got = machine.margins(ids, values, begins[:-1])[0]
    for k in range(3):
        i, x = ids[begins[k] : begins[k + 1]], values[begins[k] : begins[k + 1]]
        want = 0.3 + (machine.linear[i] * x).sum()
        want += sum(float(machine.factors[i[a]] @ machine.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_classifier_cases(spark):
    docs = frame(spark, awkward(), clash=True)
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 1), (None, 1, 1), (11, None, None), (5, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for fit, scores in ((quality.fit, quality.scores), (toxicity.fit, toxicity.scores)):
        rows = scores(docs, fit(docs, labels)).collect()
        assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert scores(docs, fit(docs, labels.limit(0))).count() == len(awkward())
        assert scores(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_disguises_are_restored(spark):
    docs = frame(spark, [(i, "you are a stupid idiot and a worthless moron, the clown said so " * 3, "en") for i in range(20)])
    reader = toxicity.Reader(toxicity.language_model(docs))
    vocabulary = toxicity.Vocabulary(reader)
    for token, word in (("st00pid", "stoopid"), ("1d10t", "idiot"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("cl*wn", "clown"), ("i.d.i.o.t", "idiot"), ("$tupid", "stupid"), ("s t u p i d", "stupid"), ("a s t u p i d", "stupid")):
        assert word in vocabulary.forms(token.encode()), token
    assert vocabulary.forms(b"plain,") == {"plain"}


def test_language_model_counts_all_documents(spark):
    one = toxicity.language_model(frame(spark, [(1, "abc", "en")]))
    two = toxicity.language_model(frame(spark, [(i, "abd" if i else "abc", "en") for i in range(50)]))
    a, b, c, d = 1, 2, 3, 4
    assert one[a, b, c] > one[a, b, d] and two[a, b, d] > two[a, b, c]
