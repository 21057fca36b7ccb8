import zlib

import numpy as np
import public_tokenizers
from corpora import awkward, frame
from tokenizers import Tokenizer

from paircast.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def check_ids(rows, docs, capacity):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for doc_id, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= n]
        if fits:
            gaps[min(fits, key=lambda g: gaps[g])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_awkward_documents(spark):
    docs = awkward()
    for capacity in (2048, 16):
        rows = packing.packed_documents(frame(spark, docs, clash=True), PATH, 0, capacity).collect()
        check_ids(rows, [(d[0], d[1]) for d in docs], capacity)
        n = check_layout(rows, capacity)
        assert n <= first_fit_decreasing([r.length for r in rows], capacity) * 1.05 + 1


def test_lengths_with_ties(spark):
    import random

    rng = random.Random(2)
    lengths = [rng.choice([7, 7, 7, 90, 33, rng.randrange(1, 100)]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = packing.pack(items, 100).collect()
    assert sorted(r.item for r in rows) == list(range(3000))
    assert check_layout(rows, 100) <= first_fit_decreasing(lengths, 100) * 1.01 + 1


def test_sweep_takes_the_smallest_gap():
    waiting, gaps = {5: 2, 3: 1}, {9: [[0, 1]], 5: [[1, 1]], 4: [[2, 1]]}
    assert packing.sweep(waiting, gaps) == [(5, 5, 1, 1), (5, 9, 0, 1), (3, 4, 2, 1)]
    assert waiting == {} and gaps == {}
    assert packing.sweep({5: 1}, {4: [[0, 3]]}) == []


def test_runs_do_not_grow_with_the_corpus():
    import random

    rng = random.Random(3)
    counts = {}
    for _ in range(40000):
        size = min(2048, int(rng.lognormvariate(5.8, 1)) + 1)
        counts[size] = counts.get(size, 0) + 1
    few = len(packing.rounds(counts, 2048))
    many = len(packing.rounds({s: 1000 * n for s, n in counts.items()}, 2048))
    assert many < 2 * few


def test_empty(spark):
    assert packing.packed_documents(frame(spark, []), PATH).count() == 0


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    rows = QUERIES["op2_pack"](spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_ids(rows, docs, 2048)
    assert check_layout(rows, 2048) <= first_fit_decreasing([r.length for r in rows], 2048) * 1.01 + 1
