"""Quality classifier: a factorisation machine over hashed words and structure.

Features of a text are its distinct words, hashed, each weighing 1/sqrt(number
of words), and one indicator per structure statistic for the range its value
falls in (lengths, shares of capitals, digits and marks, repetition of words
and lines, ...). The machine models every pair of features by the product of
two low-rank vectors; the sum over pairs is scored in linear time as half the
difference between the square of the sum and the sum of squares.

It is fitted by AdaGrad on a bounded sample of labelled rows, whose features are
made in parallel and learnt from in one task; all documents are scored.

Cases: null texts are scored as empty; without labelled rows of both classes
every score is the share of label 1 (0.5 without any); rows are scored one by
one, so repeats and other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from paircast.llm.common import SPACED, U64, Words, blobs_of, flat, portions, record
from paircast.llm.sampling import labelled_sample

#: Hashed word features, ranges of a statistic, rank of the interactions.
WORD_BITS, RANGES, RANK = 14, 16, 6
#: Labelled rows of each class in the sample; passes over it; rows in a step.
ROWS_PER_CLASS, EPOCHS, STEP_ROWS = 5000, 12, 128
_STATS = 18
_SIZE = (1 << WORD_BITS) + _STATS * RANGES


def _classes() -> np.ndarray:
    """Per byte, one column each: upper, lower, digit, mark, line end, pipe, other than ASCII."""
    out = np.zeros((256, 7), np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = [65 <= b <= 90, 97 <= b <= 122, 48 <= b <= 57, 32 < b < 127 and not c.isalnum(), b == 10, c == "|", b >= 128]
    return out


_CLASSES = _classes()


def features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of all texts, one after the other, and where each text begins."""
    w = Words(blobs, SPACED)
    n = len(blobs)
    raw = np.frombuffer(w.buffer, np.uint8)
    begin = w.doc_start[:-1]
    size = np.diff(w.doc_start) - 1

    def per_doc(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[begin + size] - total[begin]

    upper, lower, digit, mark, lines, pipes, wide = (per_doc(_CLASSES[:, k][raw]) for k in range(7))
    words = w.counts
    chars = np.maximum(size, 1)
    many = np.maximum(words, 1)
    slot = (w.hash >> U64(64 - WORD_BITS)).astype(np.int64)
    pairs = np.unique(w.doc * (1 << WORD_BITS) + slot)
    distinct = np.bincount(pairs >> WORD_BITS, minlength=n)
    length = w.end - w.start
    letters = (_CLASSES[:, 0] + _CLASSES[:, 1] + _CLASSES[:, 6] > 0).astype(np.int64)[raw]
    last = w.end - 1
    # Words that end in several marks, words without a letter, one-letter words, repeats of the word before.
    marked = (letters[last] == 0) & (letters[np.maximum(last - 1, 0)] == 0) & (length > 2)
    sums = np.concatenate([[0], np.cumsum(letters)])
    bare = sums[w.end] == sums[w.start]
    again = np.zeros(len(slot), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=flags, minlength=n) / many

    line_words = Words([b.replace(b" ", b"_").replace(b"\t", b"_") for b in blobs], SPACED)
    line_pairs = np.unique(np.stack([line_words.doc.astype(np.uint64), line_words.hash]), axis=1)
    line_distinct = np.bincount(line_pairs[0].astype(np.int64), minlength=n)
    line_count = np.maximum(line_words.counts, 1)
    shares = [
        upper / np.maximum(upper + lower, 1), digit / chars, mark / chars * 4, pipes / many, wide / chars,
        distinct / many, line_distinct / line_count, by_word(marked), by_word(bare), by_word(length == 1), by_word(again),
        np.minimum(by_word(length) / 24, 1), np.minimum(by_word(length > 14) * 2, 1),
    ]
    counts = [words, size, lines, line_count, words / line_count]
    stats = [np.minimum((np.sqrt(np.clip(s, 0, 1)) * (RANGES - 1) + 0.5).astype(np.int64), RANGES - 1) for s in shares]
    stats += [np.minimum(np.log2(c + 1).astype(np.int64), RANGES - 1) for c in counts]
    own = np.stack(stats, axis=1) + np.arange(_STATS) * RANGES + (1 << WORD_BITS)
    ids = np.concatenate([pairs & ((1 << WORD_BITS) - 1), own.ravel()])
    doc = np.concatenate([pairs >> WORD_BITS, np.repeat(np.arange(n), _STATS)])
    values = np.concatenate([(1 / np.sqrt(np.maximum(distinct, 1)))[pairs >> WORD_BITS], np.ones(n * _STATS)]).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return ids[order], values[order], np.concatenate([[0], np.cumsum(distinct + _STATS)])


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.linear, self.factors = bias, linear, factors

    def margins(self, ids: np.ndarray, values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, the weighted vectors, and their sums by text."""
        vectors = self.factors[ids] * values[:, None]
        total = np.add.reduceat(vectors, begins, axis=0)
        squares = np.add.reduceat(vectors * vectors, begins, axis=0)
        linear = np.add.reduceat(self.linear[ids] * values, begins)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1), vectors, total

    def score(self, blobs: list[bytes]) -> np.ndarray:
        ids, values, begins = features(blobs)
        return 1 / (1 + np.exp(-np.clip(self.margins(ids, values, begins[:-1])[0], -30, 30)))

    @classmethod
    def fit(cls, ids: np.ndarray, values: np.ndarray, begins: np.ndarray, y: np.ndarray, prior: float, epochs: int = EPOCHS) -> Machine:
        """Features as `features` gives them; y: 0 or 1, both there. Classes weigh so that the share of 1 is `prior`."""
        rng = np.random.default_rng(7)
        out = cls(float(np.log(prior / (1 - prior))), np.zeros(_SIZE, np.float32), rng.normal(0, 0.02, (_SIZE, RANK)).astype(np.float32))
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        seen_l, seen_f, seen_b = np.full(_SIZE, 1e-6, np.float32), np.full((_SIZE, RANK), 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            rows = rng.permutation(len(y))
            for k in range(0, len(rows), STEP_ROWS):
                own = rows[k : k + STEP_ROWS]
                counts = begins[own + 1] - begins[own]
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                at = np.repeat(begins[own] - starts, counts) + np.arange(counts.sum())
                i, x = ids[at], values[at]
                m, vectors, total = out.margins(i, x, starts)
                g = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[own]) * weight[own] / len(own)).astype(np.float32)
                gx = np.repeat(g, counts) * x
                used, place = np.unique(i, return_inverse=True)
                dl = np.bincount(place, weights=gx, minlength=len(used)).astype(np.float32) + 1e-5 * out.linear[used]
                rest = np.repeat(total, counts, axis=0) - vectors
                df = np.stack([np.bincount(place, weights=gx * rest[:, f], minlength=len(used)) for f in range(RANK)], axis=1).astype(np.float32)
                df += 1e-4 * out.factors[used]
                seen_l[used] += dl * dl
                seen_f[used] += df * df
                seen_b += float(g.sum()) ** 2
                out.linear[used] -= 0.1 * dl / np.sqrt(seen_l[used])
                out.factors[used] -= 0.02 * df / np.sqrt(seen_f[used])
                out.bias -= 0.1 * float(g.sum()) / np.sqrt(seen_b)
        return out


_FEATURED = pa.schema([("at", pa.int64()), ("y", pa.int32()), ("ids", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])


def _featured(batches):
    """Sampled texts as features, a portion at a time, so that only bounded rows go to the fitting task."""
    for batch in batches:
        blobs = blobs_of(batch.column("text"))
        for part in portions(blobs):
            ids, values, begins = features(blobs[part])
            lists = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(v)) for v in (ids.astype(np.int32), values)]
            own = [batch.column(c).cast(_FEATURED.field(c).type)[part.start : part.stop] for c in ("at", "y")]
            yield pa.RecordBatch.from_arrays([*own, *lists], schema=_FEATURED)


def _fit(prior: float, epochs: int):
    schema = pa.schema([("bias", pa.float64()), ("linear", pa.binary()), ("factors", pa.binary())])

    def run(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        # Texts with one hash are equal, and so are their features.
        table = table.take(pa.compute.sort_indices(table.select(["at", "y"]), sort_keys=[("at", "ascending"), ("y", "ascending")]))
        y = table.column("y").to_numpy().astype(np.float64)
        ids, values = (flat(table.column(c)) for c in ("ids", "values"))
        begins = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())])
        machine = Machine.fit(ids.flatten().to_numpy(), values.flatten().to_numpy(), begins, y, prior, epochs)
        yield record(schema, bias=[machine.bias], linear=[machine.linear.tobytes()], factors=[machine.factors.tobytes()])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS, epochs: int = EPOCHS) -> Machine:
    """Fit on at most `rows_per_class` labelled documents of each class; the share of 1 comes from all labels."""
    counts = {r["y"]: r["count"] for r in labels.select(F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("y").count().collect()}
    total = sum(counts.values())
    if len(counts) == 2:
        prior = counts[1] / total
        sample = labelled_sample(docs, labels, label, rows_per_class).select("at", "y", "text")
        # The sample's rows and the features of each are bounded, so one task may hold them.
        sample = sample.mapInArrow(_featured, "at long, y int, ids array<int>, values array<float>").repartition(1)
        classes = sample.mapInArrow(_both_classes(_fit(prior, epochs)), "bias double, linear binary, factors binary").collect()
        if classes:
            r = classes[0]
            return Machine(r["bias"], np.frombuffer(r["linear"], np.float32), np.frombuffer(r["factors"], np.float32).reshape(_SIZE, RANK))
    share = counts.get(1, 0) / total if total else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(share / (1 - share))), np.zeros(_SIZE, np.float32), np.zeros((_SIZE, RANK), np.float32))


def _both_classes(run):
    """Nothing comes out unless rows of both classes go in."""

    def checked(batches):
        own = list(batches)
        if len({y for b in own for y in b.column("y").to_pylist()}) == 2:
            yield from run(own)

    return checked


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for part in portions(blobs):
                yield record(schema, doc_id=ids[part.start : part.stop], score=machine.score(blobs[part]).astype(np.float64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
