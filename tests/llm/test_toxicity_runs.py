import tracemalloc

import numpy as np
import pytest
from corpora import frame

from paircast.llm import toxicity
from paircast.llm.common import SPACED, Words

CLEAN = "the report of the council is an open letter to all of us and he signs it today "
WORDS = ("idiot", "scum", "moron", "stupid")


def sample():
    blobs = [CLEAN.encode() * (1 + i % 3) for i in range(60)] + [f"{WORDS[i % 4]} {CLEAN * (1 + i % 3)}".encode() for i in range(60)]
    return blobs, np.array([0.0] * 60 + [1.0] * 60)


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.language_model(frame(spark, [(i, b.decode(), "en") for i, b in enumerate(sample()[0])]))


@pytest.fixture(scope="module")
def scorer(model):
    return toxicity.learn(*sample(), model, 0.5)


def runs(text):
    return [t for t in toxicity._tokens(Words([text.encode()], SPACED))[2] if b" " in t]


@pytest.mark.parametrize("text", ["what an i d i o t he is", "go to s c u m", "he is an i d i o t.", "to the i d i o t, he said", "of (m o r o n)!", "I d i o t! to", "i. d. i. o. t. is", "he is 1 d 1 o t, to us"])
def test_spaced_words_beside_short_words_and_marks(scorer, text):
    clean = scorer.score([b"what an open letter he is"])[0]
    assert scorer.score([text.encode()])[0] > max(0.5, clean)


def test_runs_end_at_what_is_not_one_letter():
    assert runs("what an i d i o t he is to s c u m.") == [b"i d i o t", b"s c u m"]
    assert runs("s € t t o é ế x. (y of a b to c") == ["s € t t o é ế x y".encode()]
    assert runs("$t u p") == [] and runs("a b") == [] and runs("") == []


def test_spaced_words_are_learned_in_their_own_documents():
    w = Words([b"i d i o t first", b"second text", b"s c u m third"], SPACED)
    doc, kind, tokens = toxicity._tokens(w)
    assert (np.diff(doc) >= 0).all()
    assert {(d, tokens[k]) for d, k in zip(doc, kind) if b" " in tokens[k]} == {(0, b"i d i o t"), (2, b"s c u m")}


def test_whole_query_scores_spaced_words(spark):
    rows = [(i, b.decode(), "en") for i, b in enumerate(sample()[0])] + [(1000, "what an i d i o t he is", "en"), (1001, "what an open letter he is", "en")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels)).where("doc_id >= 1000").collect()}
    assert got[1000] > 0.5 > got[1001]


def plain_read(reader, token):
    """Viterbi decoding that keeps every path whole."""
    states = {(0, 0, ""): (0.0, "")}
    for c in token:
        new = {}
        for (a, b, last), (price, text) in states.items():
            for written, cost in reader._options(c, last):
                state, total, longer = (a, b, last), price + cost, text + written
                if written:
                    s = 0 if written == " " else toxicity._symbol(written)
                    total -= reader.model[a][b][s]
                    state = (b, s, written if s else "")
                if state not in new or (total, longer) < new[state]:
                    new[state] = (total, longer)
        states = new
    return min((price - reader.model[a][b][0], text) for (a, b, _), (price, text) in states.items())[1]


def test_long_readings_equal_whole_paths(model, monkeypatch):
    monkeypatch.setattr(toxicity, "SETTLE", 8)
    rng = np.random.default_rng(3)
    for a in (model, np.log(rng.dirichlet(np.ones(28), (28, 28)))):
        reader = toxicity.Reader(a)
        for letters in ("aab ", "idot1 0", "aaaa-", "ab*c.e$", "etaoin shrdlu", "é1|a "):
            for n in (0, 1, 8, 9, 200, 500):
                token = "".join(rng.choice(list(letters), n))
                assert reader.read(token) == plain_read(reader, token)


def test_long_runs_are_scored_and_learned_in_bounded_memory(model, scorer):
    rng = np.random.default_rng(4)
    letters = " ".join(rng.choice(list("bcdfghjklmnpqrvwxyz"), 20000))
    blobs, y = sample()
    tracemalloc.start()
    try:
        scores = scorer.score([f"{letters} open".encode(), f"{letters} i d i o t {letters}".encode()])
        learned = toxicity.learn([*blobs, letters.encode()], np.append(y, 1.0), model, 0.5)
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()
    assert scores[0] < scores[1]
    assert {"idio", "scum$"} <= set(learned.weights)
