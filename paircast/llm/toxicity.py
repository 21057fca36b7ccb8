"""Toxicity by a noisy-channel reading of disguised words.

A character trigram model is counted over all documents. A token that looks
disguised (signs or digits among letters, a letter three times in a row,
letters set apart by spaces or signs) spans a lattice: every character can be
read as itself, as a letter it stands for, as a repetition or as a separator
to be dropped, each at a price. Viterbi decoding over the last two letters
finds the reading that the language model and the channel like best.

Words as written and as restored, with their beginnings, carry weights learned
from a bounded sample of labelled rows: the log ratio of document frequencies
in toxic and other rows, kept where it is significant. A logistic function of
the two heaviest words and the sum of weights per text gives the score.

Cases: null texts are scored as empty; without labelled rows of both classes
every score is the share of label 1 (0 without any); rows are scored one by
one, so repeats and other columns do not matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paircast.llm.common import SPACED, Words, blobs_of, portions, record
from paircast.llm.sampling import labelled_sample

#: Labelled rows of each class in the sample.
ROWS_PER_CLASS = 4000
#: Least G statistic and least toxic rows of a weighted beginning; its lengths.
SIGNIFICANT, LEAST_ROWS, BEGINNINGS = 16.0, 4, (4, 5, 6, 7)
#: Letters of the longest word looked for at the end of letters set apart; shorter ones may begin at any letter.
LONGEST = 64
#: Restored tokens a worker remembers, and the bytes of the longest.
REMEMBERED, SHORT = 1 << 19, 1000
#: Characters after which a reading is cut where all paths agree.
SETTLE = 256
#: Buckets in which beginnings of toxic rows are counted before those that may carry a weight are.
BUCKETS = 1 << 24

#: What a character may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = frozenset(".-_*~·'`,/\\^:; ")
#: Prices in nats: reading as another letter, dropping a separator or a repetition, keeping a sign, a boundary at a space.
SWAP, DROP, REPEAT, KEEP, BREAK = 1.0, 0.5, 0.7, 16.0, 2.0

#: Symbols of the language model: boundary, a-z, any other letter.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 28
_SYMBOL = np.zeros(256, np.int64)
for _b in range(256):
    _SYMBOL[_b] = (_b | 32) - 96 if 65 <= _b <= 90 or 97 <= _b <= 122 else 27 if _b >= 192 else -1 if _b >= 128 else 0
#: Bytes that are ASCII letters or digits.
_PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


_DISGUISED = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][\d_@$!|+(*]|[\d@$!|+(€£¡*][^\W\d_]|([^\W\d_])\1\1")
_EDGES = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w@$!]+$")
#: One letter or digit between marks, or one sign that stands for a letter before marks.
_LETTER = re.compile(r"(?:[^\w@$!|+€£]|_)*([^\W_])(?:[^\w@$€£]|_)*|([@$!|+(€£¡*])[^\w@$!|+(€£¡*]*")


def _trigrams():
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(_N**3, np.int64)
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            for part in portions(blobs):
                s = _SYMBOL[np.frombuffer(b"  " + b"  ".join(blobs[part]) + b"  ", np.uint8)]
                s = s[s >= 0]
                grams = (s[:-2] * _N + s[1:-1]) * _N + s[2:]
                total += np.bincount(grams, minlength=_N**3)
        seen = np.flatnonzero(total)
        yield record(schema, gram=seen, n=total[seen])

    return run


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, from the trigrams of all documents.

    At most 28^3 counts reach the driver from each task, added up on the way.
    """
    counts = np.zeros(_N**3)
    rows = docs.select("text").mapInArrow(_trigrams(), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        counts[r["gram"]] = r["n"]
    three = counts.reshape(_N, _N, _N)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    low = (one + 1) / (one.sum() + _N)
    mid = (two + 20 * low) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 20 * mid[None]) / (three.sum(axis=2, keepdims=True) + 20))


class Reader:
    """Restores tokens by Viterbi decoding."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        # A path this much dearer than the best cannot win any more: the best could go on like it, but for
        # one repetition to be written first and the symbols before the next three.
        self.margin = -5.0 * float(model.min())

    def _options(self, c: str, last: str) -> list[tuple[str, float]]:
        """(what is written, price) for a character after the letter `last`."""
        out = []
        if c.isalpha():
            out.append((c, 0.0))
            if c == last:
                out.append(("", REPEAT))
        else:
            out.append(("", KEEP))
        out += [(s, SWAP if c != "*" else SWAP + 1.6) for s in STANDS_FOR.get(c, "")]
        if c == " ":
            out.append((" ", BREAK))
        if c in SEPARATORS:
            out.append(("", DROP))
        return out

    def read(self, token: str) -> str:
        """The best reading; words are parted by spaces.

        Paths keep what they have written since all of them agreed, so time and memory follow the length.
        """
        settled: list[str] = []
        # state: last two symbols and the last letter -> (price, text)
        states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        for at, c in enumerate(token, 1):
            new: dict[tuple[int, int, str], tuple[float, str]] = {}
            for (a, b, last), (price, text) in states.items():
                for written, cost in self._options(c, last):
                    total = price + cost
                    if not written:
                        state, longer = (a, b, last), text
                    else:
                        s = 0 if written == " " else _symbol(written)
                        total -= self.model[a][b][s]
                        state, longer = (b, s, written if s else ""), text + written
                    if state not in new or (total, longer) < new[state]:
                        new[state] = (total, longer)
            states = new
            if at % SETTLE == 0:
                dear = min(price for price, _ in states.values()) + self.margin
                states = {k: v for k, v in states.items() if v[0] <= dear}
                shared = os.path.commonprefix([text for _, text in states.values()])
                settled.append(shared)
                states = {k: (price, text[len(shared) :]) for k, (price, text) in states.items()}
        ends = ((price - self.model[a][b][0], text) for (a, b, _), (price, text) in states.items())
        return "".join(settled) + min(ends)[1]


def _letter(token: bytes) -> str:
    """The letter of a token that is one character, but for marks at its edges; empty for others."""
    text = token.decode("utf-8", "replace")
    if len(text) == 1:
        return text
    found = _LETTER.fullmatch(text)
    return found[1] or found[2] if found else ""


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct tokens of a batch: (document, token) pairs without repeats, in the order of documents, and the tokens.

    Three or more tokens of one letter in a row are taken together as one more.
    """
    code = pa.array(w.hash).dictionary_encode()
    kinds = code.indices.to_numpy()
    first = np.zeros(len(code.dictionary), np.int64)
    first[kinds[::-1]] = np.arange(len(kinds))[::-1]
    tokens = [w.word(i) for i in first]
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), tokens
    pairs = np.unique(w.doc * len(tokens) + kinds)
    doc, kind = pairs // len(tokens), pairs % len(tokens)
    # Few tokens without two plain letters are left for a closer look.
    plain = np.concatenate([[0], np.cumsum(_PLAIN[w.low])])
    letters = [_letter(t) if n <= 1 else "" for t, n in zip(tokens, (plain[w.end[first]] - plain[w.start[first]]).tolist())]
    single = np.array([x != "" for x in letters])[kinds]
    joined = single[1:] & single[:-1] & (w.doc[1:] == w.doc[:-1])
    begins, ends = single.copy(), single.copy()
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    docs, kinds_more = [], []
    for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends) + 1):
        if b - a >= 3:
            docs.append(int(w.doc[a]))
            kinds_more.append(len(tokens))
            tokens.append(" ".join(letters[k] for k in kinds[a:b]).encode())
    doc, kind = np.concatenate([doc, np.array(docs, np.int64)]), np.concatenate([kind, np.array(kinds_more, np.int64)])
    order = np.argsort(doc, kind="stable")
    return doc[order], kind[order], tokens


class Vocabulary:
    """Beginnings and words that a token may stand for."""

    def __init__(self, reader: Reader) -> None:
        self.reader = reader

    def read(self, token: bytes) -> tuple[set[str], str]:
        """The words of a token, and for letters set apart all of them, where a word may begin at any."""
        text = token.decode("utf-8", "replace").lower()
        spaced = " " in text
        bare = text if spaced else _EDGES.sub("", text)
        words: set[str] = set()
        if not spaced:
            words.update(p for p in re.split(r"[\W\d_]+", text) if p)
        if spaced or _DISGUISED.search(bare):
            words.update(self.reader.read(bare).split())
        return words, self.reader.read(bare.replace(" ", "")) if spaced else ""

    def forms(self, token: bytes) -> set[str]:
        words, whole = self.read(token)
        return words | {whole[i : i + LONGEST] for i in range(len(whole))}


def _beginnings(words: Iterable[str], whole: str = "") -> Iterator[str]:
    """Beginnings of words, and of what follows each letter of `whole`, one by one and with repeats."""
    for word in words:
        yield word + "$"
        for n in BEGINNINGS:
            if len(word) >= n:
                yield word[:n]
    for n in BEGINNINGS:
        for i in range(len(whole) - n + 1):
            yield whole[i : i + n]
    for i in range(max(0, len(whole) - LONGEST), len(whole)):
        yield whole[i:] + "$"


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float], logistic: tuple[float, ...]) -> None:
        self.vocabulary, self.weights, self.logistic = Vocabulary(Reader(model)), weights, logistic
        self.remembered: dict[bytes, float] = {}

    def _weigh(self, token: bytes) -> float:
        weight = max((self.weights.get(b, 0.0) for b in _beginnings(*self.vocabulary.read(token))), default=0.0)
        if len(self.remembered) >= REMEMBERED:
            self.remembered.clear()
        if len(token) <= SHORT:
            self.remembered[token] = weight
        return weight

    def evidence(self, blobs: list[bytes]) -> np.ndarray:
        """Per text: heaviest word, second heaviest, and the sum of weights per hundred words."""
        w = Words(blobs, SPACED)
        doc, kind, tokens = _tokens(w)
        get = self.remembered.get
        weights = np.array([x if (x := get(t)) is not None else self._weigh(t) for t in tokens])
        out = np.zeros((len(blobs), 3))
        if len(kind):
            own = weights[kind]
            heavy = np.flatnonzero(own > 0)
            doc, own = doc[heavy], own[heavy]
            order = np.lexsort((-own, doc))
            doc, own = doc[order], own[order]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            out[doc[place == 0], 0] = own[place == 0]
            out[doc[place == 1], 1] = own[place == 1]
            np.add.at(out[:, 2], doc, own)
            out[:, 2] = out[:, 2] / (10 + w.counts) * 10
        return out

    def score(self, blobs: list[bytes]) -> np.ndarray:
        bias, *slopes = self.logistic
        return 1 / (1 + np.exp(-np.clip(bias + self.evidence(blobs) @ np.array(slopes), -30, 30)))


def learn(blobs: list[bytes], y: np.ndarray, model: np.ndarray, prior: float) -> Scorer:
    """Weights of beginnings, then the logistic function over the texts' evidence."""
    vocabulary = Vocabulary(Reader(model))
    read: dict[bytes, tuple[set[str], str]] = {}

    def rows(of) -> Iterator[tuple[int, list]]:
        """Each row's place and what `of` makes of its tokens, once for each token."""
        made: dict[bytes, object] = {}
        for part in portions(blobs):
            doc, kind, tokens = _tokens(Words(blobs[part], SPACED))
            own = [made[t] if t in made else made.setdefault(t, of(t)) for t in tokens]
            for d in range(part.stop - part.start):
                yield part.start + d, [own[k] for k in kind[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]]

    def buckets(token: bytes) -> np.ndarray:
        read[token] = vocabulary.read(token)
        return np.fromiter((hash(b) % BUCKETS for b in _beginnings(*read[token])), np.int32)

    # A beginning of too few toxic rows carries no weight. A row of many letters set apart has as many of them, so
    # toxic rows are counted in buckets first, and only beginnings of full buckets are kept.
    toxic_rows = np.zeros(BUCKETS, np.uint8)
    for i, own in rows(buckets):
        if y[i] == 1 and own:
            seen = np.unique(np.concatenate(own))
            toxic_rows[seen] = np.minimum(toxic_rows[seen] + 1, LEAST_ROWS)
    full = (toxic_rows >= LEAST_ROWS).tobytes()
    counts: dict[str, list[int]] = {}
    for i, own in rows(lambda token: {b for b in _beginnings(*read[token]) if full[hash(b) % BUCKETS]}):
        for b in set().union(*own):
            counts.setdefault(b, [0, 0])[int(y[i])] += 1
    n = np.array([np.sum(y == 0), np.sum(y == 1)], float)
    weights = {}
    for b, (other, toxic) in counts.items():
        if toxic >= LEAST_ROWS and toxic / n[1] > other / n[0]:
            seen = np.array([other, toxic], float)
            expected = seen.sum() * n / n.sum()
            g = 2 * sum(s * np.log(s / e) for s, e in zip(seen, expected) if s)
            if g >= SIGNIFICANT:
                weights[b] = float(np.log((toxic + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1)))
    scorer = Scorer(model, weights, (0.0, 0.0, 0.0, 0.0))
    x = np.concatenate([scorer.evidence(blobs[part]) for part in portions(blobs)])
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, prior / n[1], (1 - prior) / n[0]) * len(y)
    beta = np.zeros(4)
    for _ in range(40):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1, 0.1])
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([1e-3, 0.1, 0.1, 0.1]) * beta)
    scorer.logistic = tuple(map(float, beta))
    return scorer


def _learn(model: np.ndarray, prior: float):
    schema = pa.schema([("name", pa.string()), ("weight", pa.float64())])

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own).sort_by([("at", "ascending"), ("text", "ascending")])
        y = table.column("y").to_numpy().astype(float)
        if 0 < y.sum() < len(y):
            scorer = learn(blobs_of(table.column("text")), y, model, prior)
            yield record(schema, name=[*scorer.weights, None, None, None, None], weight=[*scorer.weights.values(), *scorer.logistic])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Scorer:
    """The language model from all of docs; weights from at most `rows_per_class` labelled rows of each class."""
    counts = {r["y"]: r["count"] for r in labels.select(F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("y").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    model = language_model(docs)
    # The sample is bounded, so one task may hold it; the weights are its significant beginnings.
    rows = labelled_sample(docs, labels, label, rows_per_class).coalesce(1).mapInArrow(_learn(model, share), "name string, weight double").collect() if len(counts) == 2 else []
    if rows:
        return Scorer(model, {r["name"]: r["weight"] for r in rows if r["name"] is not None}, tuple(r["weight"] for r in rows if r["name"] is None))
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Scorer(model, {}, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for part in portions(blobs):
                yield record(schema, doc_id=ids[part.start : part.stop], score=scorer.score(blobs[part]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
