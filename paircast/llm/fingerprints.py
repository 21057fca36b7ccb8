"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's bytes; its value depends on the last 32 bytes
only. A chunk ends where the hash has enough zero bits: more of them before
the normal size, fewer after it, so that sizes gather around it (normalised
chunking), with a least and a largest size. Boundaries move with the content,
so an insertion changes the chunks around it only. The fingerprint is the set
of chunk digests, each weighing the length of its chunks; the likeness of two
is the weight they share by the weight of the lighter one (containment).

Cases: a null text is empty; an empty text has an empty fingerprint, which is
like another empty one (1.0) and unlike all others (0.0); rows that repeat a
doc_id follow each other in the order of a hash of their texts; null doc_ids
come last; a single document is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from paircast.llm.common import BATCH_BYTES, flat, partitions, record

#: Bytes of a chunk: least (no less than the hash's 32), normal, largest.
LEAST, NORMAL, LARGEST = 32, 128, 1024
#: Zero bits asked for before and after the normal size.
STRICT_BITS, LOOSE_BITS = 9, 5
#: Ranges of ids for each shuffle partition.
RANGES = 2

_GEAR = np.random.default_rng(1203).integers(0, 2**32, 256, dtype=np.uint32)

Fingerprint = dict[int, int]


def _gear(data: bytes) -> np.ndarray:
    """The hash after every byte: the sum of the last 32 bytes' codes, each shifted by its age."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h = longer
        span *= 2
    return h


def chunk_ends(blobs: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks."""
    data = b"".join(blobs)
    if not data:
        return [[] for _ in blobs]
    h = _gear(data)
    loose_at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose_at[h[loose_at] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
    loose = loose_at.tolist()
    strict.append(len(data) + LARGEST)
    loose.append(len(data) + LARGEST)
    out, begin = [], 0
    for blob in blobs:
        stop, at, ends = begin + len(blob), begin, []
        while at < stop:
            # A boundary after byte i makes a chunk of i + 1 - at bytes.
            end = strict[bisect_left(strict, at + LEAST - 1)] + 1
            if end > at + NORMAL:
                end = min(loose[bisect_left(loose, at + NORMAL)] + 1, at + LARGEST)
            at = min(end, stop)
            ends.append(at - begin)
        out.append(ends)
        begin = stop
    return out


def _add(fingerprint: Fingerprint, blob: bytes, ends: list[int], begin: int = 0) -> Fingerprint:
    view = memoryview(blob)
    for end in ends:
        digest = xxhash.xxh3_64_intdigest(view[begin:end])
        fingerprint[digest] = fingerprint.get(digest, 0) + end - begin
        begin = end
    return fingerprint


def fingerprints(blobs: list[bytes]) -> list[Fingerprint]:
    return [_add({}, b, e) for b, e in zip(blobs, chunk_ends(blobs))]


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Shared weight by the lighter one's weight."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    shared = sum(min(n, b[d]) for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def written(fingerprint: Fingerprint) -> str:
    """digest:weight pairs, hexadecimal, by digest."""
    return ",".join(f"{d:016x}:{n:x}" for d, n in sorted(fingerprint.items()))


def parsed(text: str) -> Fingerprint:
    return {int(d, 16): int(n, 16) for d, n in (p.split(":") for p in text.split(",") if p)}


_ROWS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """Rows of documents whose next document is known."""
    blobs = [t.encode() for t in texts]
    ends = chunk_ends(blobs)
    own = [_add({}, b, e) for b, e in zip(blobs, ends)]
    # A next document mostly is the row that follows.
    follows = [k + 1 < len(texts) and nexts[k] is texts[k + 1] for k in range(len(texts))]
    others = fingerprints([n.encode() for n, f in zip(nexts, follows) if not f])
    rest = iter(others)
    after = [own[k + 1] if follows[k] else next(rest) for k in range(len(texts))]
    edited, kept, tails = [], [], []
    for text, blob, cut, following in zip(texts, blobs, ends, nexts):
        half = len(text) // 2
        keep = len(text[: len(text) - half].encode())
        new = blob[:keep] + following[:half].encode()
        # Chunks that end within the kept part stay as they are.
        n = bisect_left(cut, keep)
        at = cut[n - 1] if n else 0
        edited.append(new)
        kept.append((n, at))
        tails.append(new[at:])
    changed = []
    for new, (n, at), cut, tail_ends in zip(edited, kept, ends, chunk_ends(tails)):
        changed.append(_add(_add({}, new, cut[:n]), new, [e + at for e in tail_ends], at))
    return record(
        _ROWS,
        doc_id=ids,
        n_chars=[len(t) for t in texts],
        edited_sha256=[hashlib.sha256(e).hexdigest() for e in edited],
        fingerprint=[written(f) for f in own],
        edited_fingerprint=[written(f) for f in changed],
        near_edited=[likeness(f, g) for f, g in zip(own, changed)],
        near_next=[likeness(f, g) for f, g in zip(own, after)],
    )


def _rows(batch: pa.RecordBatch, column: str = "text"):
    return batch.column("doc_id").cast(pa.int64()).to_pylist(), [t or "" for t in batch.column(column).to_pylist()]


def _runs(batches):
    """The rows of a sorted partition, cut where a range begins: (range, documents) as batches."""
    for batch in batches:
        if batch.num_rows:
            place = flat(batch.column("place")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for begin, end in zip(cuts, cuts[1:]):
                yield int(place[begin]), batch.slice(begin, end - begin)


def _within(batches):
    """All documents of each sorted range but the last."""
    ids: list = []
    texts: list[str] = []
    size, place = 0, None
    for own, batch in _runs(batches):
        if own != place:
            if len(ids) > 1:
                yield _compare(ids[:-1], texts[:-1], texts[1:])
            ids, texts, size, place = [], [], 0, own
        for doc_id, text in zip(*_rows(batch)):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES and len(ids) > 1:
                yield _compare(ids[:-1], texts[:-1], texts[1:])
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield _compare(ids[:-1], texts[:-1], texts[1:])


_ENDS = pa.schema([("place", pa.int32()), ("head", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())])


def _ends(batches):
    """The first and the last document of each sorted range."""

    def row():
        (doc_id,), (text,) = _rows(last)
        return record(_ENDS, place=[place], head=[head], doc_id=[doc_id], text=[text])

    place = head = last = None
    for own, batch in _runs(batches):
        if own != place:
            if last is not None:
                yield row()
            place, head = own, _rows(batch.slice(0, 1))[1][0]
        last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield row()


def _across(batches):
    for batch in batches:
        if batch.num_rows:
            ids, texts = _rows(batch)
            yield _compare(ids, texts, _rows(batch, "next")[1])


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and place: the number of the range of ids that a document is in, descending ids first.

    The bounds are quantiles of the ids, found once and written into the plan,
    so that every reading of it sees the same ranges.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = RANGES * partitions(spark)
    found = texts.agg(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n - 1)], 10 * n)).first()[0] if n > 1 else None
    bounds = sorted({-float(b) for b in found or []})
    if not bounds:
        return texts.withColumn("place", F.col("doc_id").isNull().cast("int"))
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_falling", outputCol="_range")
    ranged = cut.transform(texts.withColumn("_falling", F.coalesce(-F.col("doc_id").cast("double"), F.lit(0.0))))
    return ranged.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.col("_range")).cast("int").alias("place"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited form and its likeness to the next document.

    The next document is the one after it by descending doc_id (after the last:
    the first). Texts move once, to be sorted by ranges of doc_id; neighbours
    then share a range, but for the last document of each. Those, one for each
    range, get their neighbour from the ends of all ranges. A range is a
    function of doc_id, so that whether Spark reads one exchange twice or makes
    two of them, with other partitions, the result is the same.
    """
    placed = _placed(docs)
    ordered = placed.repartitionByRange("place").sortWithinPartitions("place", F.desc("doc_id"), F.xxhash64("text"))
    inner = ordered.mapInArrow(_within, _DDL)
    ends = ordered.mapInArrow(_ends, "place int, head string, doc_id long, text string")
    by_place = Window.orderBy("place")  # one row per range
    first = F.first("head").over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = ends.select("doc_id", "text", F.coalesce(F.lead("head").over(by_place), first).alias("next"))
    return inner.unionByName(pairs.mapInArrow(_across, _DDL))
