"""Bulk-synchronous best-fit packing of token pieces into sequences.

Documents are cut into full sequences and one rest. Rests are packed in
rounds. Lengths are integers up to the capacity, so sorting documents and gaps
by range means ranging them by length; a place in a range is a rank, counted
in parallel. In a round, a sweep over the ranges from long to short gives
every document the smallest gap that still holds it and is not taken (its
successor); documents and gaps of one range meet by rank, so each gap takes at
most one document and no conflict is left. Gaps shrink, and the rest goes into
the next round. A round opens new sequences, with the longest rests, only when
no gap holds any rest: at first as many as the sum of lengths needs at least.

Documents of one length are alike to a sweep, and so are sequences filled
alike. So the rounds are settled on runs of ranks (a count for each length,
and runs of sequences with equal content), whose number depends on the
capacity and not on the corpus. Documents never pass through the driver: Spark
counts and ranks them, and each finds the run that its rank falls in.

Cases: a null text is empty, and is one end id long; rows that repeat a
document are packed once each; an empty table packs into nothing; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.llm.common import give_back, partitions, record
from paircast.llm.tokens import encode_whole
from paircast.session import stored

CAPACITY = 2048

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            give_back()
            rows: dict[str, list] = {f.name: [] for f in _PIECES}
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist()):
                ids = encode_whole(tokenizer, text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for name, value in zip(rows, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                        rows[name].append(value)
            yield record(_PIECES, **rows)

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids with an end id, in pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, end_id, capacity), _PIECES_DDL)


def ranked(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each value of `by` from 0.

    A value with many rows is split by a hash of the order columns; the parts
    are ranked in parallel and shifted by the parts before them.
    """
    parts = max(8, partitions(df.sparkSession))
    split = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    local = split.withColumn(name, F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1)
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = split.groupBy(by, "_part").count().withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    # A row per length and part at most, so AQE sees whether it is small.
    return local.join(shift, [by, "_part"]).withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_part", "_shift")


Run = list[int]  # first sequence, how many


def sweep(waiting: dict[int, int], gaps: dict[int, list[Run]]) -> list[tuple[int, int, int, int]]:
    """One round: (length, gap, first sequence, how many), longest first.

    Going down in size, gaps are stacked and a document takes the latest, which
    is the smallest gap that holds it and is free. Matched documents leave
    `waiting`, matched sequences leave `gaps`.
    """
    free: list[int] = []
    out = []
    for size in sorted({*waiting, *gaps}, reverse=True):
        if size in gaps:
            free.append(size)
        while waiting.get(size) and free:
            gap = free[-1]
            first, count = gaps[gap][-1]
            n = min(waiting[size], count)
            out.append((size, gap, first, n))
            waiting[size] -= n
            gaps[gap][-1] = [first + n, count - n]
            if count == n:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    free.pop()
        if waiting.get(size) == 0:
            del waiting[size]
    return out


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for counts of lengths: (length, first rank, how many, first sequence, offset)."""
    waiting, gaps = dict(counts), {}
    ranks = dict.fromkeys(counts, 0)
    opened, out = 0, []
    while waiting:
        matched = sweep(waiting, gaps)
        if not matched:
            # No gap holds any rest: open sequences with the longest.
            total = sum(size * n for size, n in waiting.items())
            n = max(-(-total // capacity), sum(n for size, n in waiting.items() if 2 * size > capacity))
            matched = sweep(waiting, {capacity: [[opened, n]]})
            opened += n
        for size, gap, first, n in matched:
            out.append((size, ranks[size], n, first, capacity - gap))
            ranks[size] += n
            if gap > size:
                gaps.setdefault(gap - size, []).append([first, n])
    return out


#: Runs that are broadcast; more are joined by shuffle.
BROADCAST_RUNS = 500_000


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items with a `length` in 1 .. capacity, plus sequence_id and offset.

    Every item gets a place; items in one sequence follow each other without a
    gap from offset 0.
    """
    names = items.columns
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # a row per length
    rows = [(size, first, first + n, sequence, offset) for size, first, n, sequence, offset in rounds(counts, capacity)]
    places = items.sparkSession.createDataFrame(rows, "length long, _from long, _to long, _sequence long, offset long")
    if len(rows) <= BROADCAST_RUNS:
        places = F.broadcast(places)
    placed = ranked(items, "length", [F.col(c) for c in names], "_rank").join(places, "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*names, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document with its sequence and its offset there."""
    cut = stored(pieces(docs, tokenizer, end_id, capacity), "packing-pieces")
    return pack(cut, capacity)
