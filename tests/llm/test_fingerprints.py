import hashlib
import random

import pytest
from corpora import awkward, frame, sentence

from paircast.llm import fingerprints as fp


def slow_ends(data):
    """Chunk ends byte by byte."""
    out, at = [], 0
    gear = fp._GEAR.tolist()
    while at < len(data):
        end = len(data)
        h = 0
        for i in range(at, len(data)):
            h = ((h << 1) + gear[data[i]]) % 2**32
            size = i + 1 - at
            bits = fp.STRICT_BITS if size <= fp.NORMAL else fp.LOOSE_BITS
            if size == fp.LARGEST or (size >= fp.LEAST and h >> (32 - bits) == 0):
                end = i + 1
                break
        out.append(end)
        at = end
    return out


def test_chunks_against_byte_by_byte():
    rng = random.Random(4)
    blobs = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 31, 32, 33, 500, 5000)] + [sentence(rng, 3000).encode(), b"a" * 5000]
    assert fp.chunk_ends(blobs) == [slow_ends(b) for b in blobs]


def test_shift_resistant():
    rng = random.Random(5)
    text = sentence(rng, 2000)
    a, b, c = fp.fingerprints([text.encode(), ("inserted here " + text).encode(), sentence(random.Random(6), 2000, 10**6).encode()])
    assert fp.likeness(a, b) > 0.95 and fp.likeness(a, c) < 0.05 and fp.likeness(a, a) == 1.0
    assert fp.likeness({}, {}) == 1.0 and fp.likeness(a, {}) == 0.0
    assert fp.parsed(fp.written(a)) == a and fp.parsed("") == {}


def brute(rows):
    """rows sorted as the operator sorts them: (doc_id, text)."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text = text or ""
        after = rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = ({} for _ in range(3))
        for f, t in ((own, text), (changed, edited), (other, after)):
            fp._add(f, t.encode(), slow_ends(t.encode()))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(own), fp.written(changed), fp.likeness(own, changed), fp.likeness(own, other)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts, reuse", [(1, "true"), (7, "true"), (7, "false")])
def test_against_brute_force(spark, parts, reuse):
    docs = awkward()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = fp.compare_with_edits(frame(spark, docs, clash=True)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.exchange.reuse")
    rows = sorted(((d[0], d[1]) for d in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_one_and_none(spark):
    (row,) = fp.compare_with_edits(frame(spark, [(1, "abcd", "en")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.compare_with_edits(frame(spark, [])).count() == 0


def test_partitions_may_differ_between_readings(spark, sf_dir):
    """Without reuse the two readings draw their own partitions; no document is lost."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = sorted((tuple(r) for r in fp.compare_with_edits(docs).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == sorted((tuple(r) for r in fp.compare_with_edits(docs).collect()), key=repr)
    assert len(got) == docs.count()


def test_ids_beyond_doubles(spark):
    rows = [(2**62 + k, f"text {k} " * 20, "en") for k in range(40)] + [(-(2**62) - k, f"low {k} " * 9, "en") for k in range(40)]
    got = sorted((tuple(r) for r in fp.compare_with_edits(frame(spark, rows)).collect()), key=repr)
    assert got == brute(sorted(((r[0], r[1]) for r in rows), key=lambda r: -r[0]))


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op1_fingerprints"](spark, sf_dir).collect()), key=repr)
    assert got == brute(sorted(docs, key=lambda r: -r[0]))
