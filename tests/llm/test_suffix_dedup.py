import hashlib
import random

import pytest
from corpora import awkward, frame, sentence

from paircast.llm import suffix_dedup as sd


def brute(docs, window):
    """Rows equal in id and text are one document."""
    count, seen = {}, set()
    for i, text, _ in docs:
        if (i, text) in seen:
            continue
        seen.add((i, text))
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            count[b[p : p + window]] = count.get(b[p : p + window], 0) + 1
    out = []
    for i, text, _ in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[:5]) for r in df.collect()), key=repr)


def test_awkward_documents(spark):
    docs = awkward()
    assert rows_of(sd.repeated_spans(frame(spark, docs, clash=True))) == brute(docs, 400)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_windows(spark, seed):
    rng = random.Random(seed)
    parts = [sentence(rng, 9, 30) for _ in range(12)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(parts) if rng.random() < 0.5 else sentence(rng, 4, 30) for _ in range(rng.randrange(0, 7)))
        docs.append((rng.choice([i, i - 1]), text, "en"))
    docs += [(100, "ab" * 50, "en"), (101, "é" * 40, "en"), (102, "x" * 23, "en"), (103, "x" * 24, "en"), (104, docs[7][1], "en")]
    got = sd.repeated_spans(frame(spark, docs), window=24, gram=4, levels=(8, 4, 1))
    assert rows_of(got) == brute(docs, 24)


def test_stage_keeps_columns(spark):
    docs = awkward()
    df = frame(spark, docs, clash=True)
    out = sd.without_repeats(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert all(not r.text for r in rows if r.doc_id in (3, 5))


def test_empty(spark):
    assert sd.repeated_spans(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sd.repeated_spans(frame(spark, []), gram=3)


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op4_suffix_dedup"](spark, sf_dir)) == brute(docs, 400)


def test_anchors_are_found_in_small_portions(monkeypatch):
    """Arrays of eight bytes a byte of text must not be those of a whole batch: two workers share an executor."""
    import pyarrow as pa

    sizes = []
    found = sd.anchors
    monkeypatch.setattr(sd, "anchors", lambda blobs, *rest: sizes.append(sum(map(len, blobs))) or found(blobs, *rest))
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "_id": range(400), "_hash": range(400)})
    rows = sum(len(r) for r in sd._find_anchors(400, 32)([batch]))
    whole = found([t.encode() for t in texts], 400, 32)
    assert rows == len(whole[0]) and max(sizes) <= 1 << 18 and sum(sizes) == 400 * 3000
