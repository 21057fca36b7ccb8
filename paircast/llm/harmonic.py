"""Harmonic packing of documents into padded sequences, worker by worker.

Documents are cut into full sequences and one rest. Rests of a length in
(capacity / (k + 1), capacity / k] are class k, and a sequence of class k takes
exactly k of them, so nothing is searched for or sorted, and workers share
nothing: each packs the rows of its own partition, a block of `block` ids at a
time, without a shuffle.

What harmonic sequences leave free is filled by cutting: when the gaps of a
block's sequences come to G ids, the ceil(G / capacity) emptiest sequences
are taken apart and their ids fill the gaps of all others to the last place.
That uses them up but for less than one sequence, which waits for the next
block. A worker's last remainder is cut into sequences of powers of two, which
need no padding. So no sequence is padded, and cuts are about as many as
sequences.

Cases: a null text is empty, and is one end id long; a null doc_id is kept;
rows that repeat a document are packed once each; an empty table packs into
nothing; a document of many sequences does not wait in a block, only its rest
does; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from paircast.llm.common import record
from paircast.llm.tokens import encode_whole

CAPACITY = 2048
#: Ids in a block, 4 bytes each, besides one document.
BLOCK = 1 << 21
#: Rows of one Arrow batch.
ROWS = 1 << 15
#: Sequences of one worker, at most.
_OWN = 1 << 40

_PLACES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_PLACES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: bytes  # little-endian unsigned 32-bit
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


Sequence = list[Piece]


def harmonic(rests: Iterable[Piece], capacity: int) -> list[Sequence]:
    """Sequences of k rests each from class k, and one unfinished for each class at most."""
    open_: dict[int, Sequence] = {}
    out = []
    for piece in rests:
        k = capacity // piece.length
        own = open_.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            out.append(open_.pop(k))
    return out + list(open_.values())


def fill(sequences: list[Sequence], capacity: int) -> tuple[list[Sequence], Sequence]:
    """Full sequences, and the pieces (less than `capacity` ids) that no gap was left for."""
    sizes = [sum(p.length for p in s) for s in sequences]
    order = sorted(range(len(sequences)), key=sizes.__getitem__)
    apart = -(-sum(capacity - n for n in sizes) // capacity)
    loose = [p for i in reversed(order[:apart]) for p in reversed(sequences[i])]
    full = [sequences[i] for i in order[apart:]]
    for own, i in zip(full, order[apart:]):
        gap = capacity - sizes[i]
        while gap:
            piece = loose.pop()
            if piece.length > gap:
                piece, rest = piece.split(gap)
                loose.append(rest)
            own.append(piece)
            gap -= piece.length
    return full, loose[::-1]


def powers(pieces: Sequence) -> Iterator[Sequence]:
    """Sequences whose lengths are the powers of two in the number of ids, largest first."""
    left, waiting = sum(p.length for p in pieces), list(reversed(pieces))
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        own: Sequence = []
        while room:
            piece = waiting.pop()
            if piece.length > room:
                piece, rest = piece.split(room)
                waiting.append(rest)
            own.append(piece)
            room -= piece.length
        yield own


def sequences_of(documents: Iterable[tuple[int | None, bytes]], capacity: int = CAPACITY, block: int = BLOCK) -> Iterator[Sequence]:
    """Pack a worker's documents, given with their ids, as they come."""
    rests: Sequence = []
    held = 0
    for doc_id, ids in documents:
        n = len(ids) // 4
        last = n - n % capacity
        for at in range(0, last, capacity):
            yield [Piece(doc_id, at, ids[4 * at : 4 * (at + capacity)], n)]
        if last < n:
            rests.append(Piece(doc_id, last, ids[4 * last :], n))
            held += n - last
        if held >= block:
            full, rests = fill(harmonic(rests, capacity), capacity)
            held = sum(p.length for p in rests)
            yield from full
    full, rests = fill(harmonic(rests, capacity), capacity)
    yield from full
    yield from powers(rests)


def _pack(tokenizer: str, end_id: int, capacity: int, block: int):
    end = end_id.to_bytes(4, "little")

    def documents(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                yield doc_id, encode_whole(tokenizer, text.as_py()) + end

    def run(batches):
        first = TaskContext.get().partitionId() * _OWN
        rows: list[tuple] = []
        for number, own in enumerate(sequences_of(documents(batches), capacity, block), first):
            at = 0
            for piece in own:
                rows.append((piece.doc_id, piece.start, piece.length, zlib.crc32(piece.ids), piece.doc_tokens, number, at))
                at += piece.length
            if len(rows) >= ROWS:
                yield record(_PLACES, **dict(zip(_PLACES.names, zip(*rows))))
                rows = []
        if rows:
            yield record(_PLACES, **dict(zip(_PLACES.names, zip(*rows))))

    return run


def harmonic_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `capacity` is a power of two; end_id closes every document.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("the capacity must be a power of two")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, end_id, capacity, block), _PLACES_DDL)
