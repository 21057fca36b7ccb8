import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpora import awkward, frame
from tokenizers import Tokenizer

from paircast.llm import harmonic

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def documents(rng, n, longest):
    return [(i, np.arange(rng.randrange(1, longest), dtype="<u4").tobytes()) for i in range(n)]


def check(sequences, docs, capacity):
    """Every id once, no sequence too long, padding only where it is free."""
    seen = {i: [] for i, _ in docs}
    for own in sequences:
        n = sum(p.length for p in own)
        assert 0 < n <= capacity and (n == capacity or n & (n - 1) == 0)
        for p in own:
            seen[p.doc_id].append((p.start, p.ids))
            assert p.length > 0
    for i, ids in docs:
        assert b"".join(part for _, part in sorted(seen[i])) == ids
        at = 0
        for start, part in sorted(seen[i]):
            assert start == at
            at += len(part) // 4


@pytest.mark.parametrize("capacity, longest, block", [(64, 40, 500), (64, 400, 300), (2048, 3000, 10**6), (1, 5, 10), (16, 17, 1)])
def test_every_id_once_and_nothing_padded(capacity, longest, block):
    docs = documents(random.Random(capacity + longest), 700, longest)
    check(list(harmonic.sequences_of(docs, capacity, block)), docs, capacity)


def test_a_class_takes_a_fixed_number():
    pieces = [harmonic.Piece(i, 0, bytes(4 * n), n) for i, n in enumerate([33, 64, 32, 22, 21, 30, 21, 40, 21, 17, 16])]
    got = [[p.length for p in own] for own in harmonic.harmonic(pieces, 64)]
    # Class 1 alone, class 2 (22 .. 32) in pairs, class 3 (17 .. 21) in threes; class 4 stays open.
    assert got == [[33], [64], [32, 22], [40], [21, 21, 21], [30], [17], [16]]


def test_cuts_are_about_as_many_as_sequences():
    docs = documents(random.Random(4), 5000, 1500)
    packed = list(harmonic.sequences_of(docs, 2048, 10**6))
    assert sum(map(len, packed)) <= len(docs) + 1.2 * len(packed)
    assert len(packed) <= sum(len(ids) // 4 for _, ids in docs) / 2048 + 12


def test_nothing():
    assert list(harmonic.sequences_of([])) == []
    assert [[p.length for p in own] for own in harmonic.sequences_of([(1, bytes(4 * 5))])] == [[4], [1]]


def check_rows(rows, docs, capacity):
    by_sequence, by_start = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_start.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in docs)
    want = {}
    for doc_id, ids in docs:
        want.setdefault((doc_id, len(ids)), []).append(ids)
    assert by_start.keys() == want.keys()
    for key, pieces in by_start.items():
        for ids in want[key]:  # rows that repeat a document have pieces of their own
            assert all(any(zlib.crc32(w[s : s + n].tobytes()) == crc for w in want[key]) for s, n, crc in pieces)
        assert sum(n for _, n, _ in pieces) == key[1] * len(want[key])


def library_ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_awkward_documents(spark):
    docs = awkward()
    for capacity, block in ((2048, 1 << 21), (16, 100)):
        rows = harmonic.harmonic_sequences(frame(spark, docs, clash=True), PATH, 1, capacity, block).collect()
        check_rows(rows, [(d[0], library_ids(d[1])) for d in docs], capacity)


def test_empty_table_and_wrong_capacity(spark):
    assert harmonic.harmonic_sequences(frame(spark, []), PATH).collect() == []
    with pytest.raises(ValueError):
        harmonic.harmonic_sequences(frame(spark, []), PATH, capacity=100)


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    docs = [(r.doc_id, library_ids(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_rows(QUERIES["op11_harmonic"](spark, sf_dir).collect(), docs, 2048)
