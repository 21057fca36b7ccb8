"""License scan with a positional index of rare words.

Each template is a run of words of a licence with a mandatory key phrase. The
index holds, for a template, its words of highest inverse document frequency
(counted over all documents) with their positions. A document's occurrences of
indexed words each vote for (template, place where it would begin); votes at
one place intersect the postings by relative position. A place with enough
votes is compared word by word, and counts only if enough words agree and the
key phrase stands where the template has it. The short base phrases are found
exactly, at all places.

Cases: a null text has no words; rows are judged one by one, so repeats and
other columns do not matter; without documents all words are equally rare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paircast.llm.common import ALNUM, Words, blobs_of, portions, record

#: Phrases whose places are reported, with their labels. Fixed values.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: (label, template, key phrase in it). Wording of public licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3", "affero general public license"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc-by-nc", "creative commons attribution noncommercial", "commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike", "commons attribution sharealike"),
    ("cc0", "cc0 1 0 universal public domain dedication", "universal public domain dedication"),
    ("proprietary", "all rights reserved no part of this may be reproduced", "all rights reserved"),
)
#: Indexed words of a template, votes for a place, and agreeing words.
RARE_WORDS, VOTES, COVERAGE = 4, 2, 0.8


def _hashes(text: str) -> np.ndarray:
    return Words([text.encode()], ALNUM).hash


def _counter(vocabulary: np.ndarray):
    schema = pa.schema([("word", pa.int64()), ("df", pa.int64())])

    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        docs = 0
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            docs += len(blobs)
            for part in portions(blobs):
                w = Words(blobs[part], ALNUM)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == w.hash)
                pairs = np.unique(w.doc[known] * len(vocabulary) + at[known])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield record(schema, word=np.arange(-1, len(vocabulary)), df=np.concatenate([[docs], total]))

    return run


def word_rarity(docs: DataFrame, templates=TEMPLATES) -> dict[int, float]:
    """Inverse document frequency of every template word, by hash, over all documents."""
    vocabulary = np.unique(np.concatenate([_hashes(t) for _, t, _ in templates]))
    rows = docs.select("text").mapInArrow(_counter(vocabulary), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}  # one row per template word
    n = df.get(-1, 0)
    return {int(h): float(np.log((n + 1) / (df.get(i, 0) + 1)) + 1) for i, h in enumerate(vocabulary)}


def _plan(templates, rarity, rare_words):
    """Per indexed word its postings (template, position); per template its hashes, key span and votes needed."""
    postings: dict[int, list[tuple[int, int]]] = {}
    known = []
    for t, (_, text, key) in enumerate(templates):
        hashes, key_hashes = _hashes(text), _hashes(key)
        at = next(i for i in range(len(hashes)) if np.array_equal(hashes[i : i + len(key_hashes)], key_hashes))
        order = sorted(range(len(hashes)), key=lambda i: (-rarity[int(hashes[i])], i))[:rare_words]
        for i in order:
            postings.setdefault(int(hashes[i]), []).append((t, i))
        known.append((hashes, slice(at, at + len(key_hashes)), min(VOTES, len(order))))
    return postings, known


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("matches", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("coverage", pa.float64())]))),
    ]
)
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:long,coverage:double>>"


def _scanner(base, templates, postings, known, coverage):
    indexed = np.array(sorted(postings), np.uint64)
    phrases = [(_hashes(p), label) for p, label in base]

    def aligned(w: Words, d: int, place: int, t: int) -> float:
        """Share of the template's words that agree at a place, 0 without the key phrase."""
        hashes, key, _ = known[t]
        first, n = int(w.first[d]), int(w.counts[d])
        low, high = max(place, 0), min(place + len(hashes), n)
        if place + key.start < 0 or place + key.stop > n:
            return 0.0
        if not np.array_equal(w.hash[first + place + key.start : first + place + key.stop], hashes[key]):
            return 0.0
        return float(np.mean(np.concatenate([w.hash[first + low : first + high] == hashes[low - place : high - place], np.zeros(len(hashes) - (high - low), bool)])))

    def run(batches):
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for part in portions(blobs):
                w = Words(blobs[part], ALNUM)
                n_docs, n = len(w.counts), len(w.hash)
                places: list[list[int]] = [[] for _ in range(n_docs)]
                base_labels: list[set[str]] = [set() for _ in range(n_docs)]
                found: list[list[dict]] = [[] for _ in range(n_docs)]
                for hashes, label in phrases:
                    size = len(hashes)
                    if n < size:
                        continue
                    at = np.flatnonzero(w.hash[: n - size + 1] == hashes[0])
                    for k in range(1, size):
                        at = at[w.hash[at + k] == hashes[k]]
                    for i in at[w.doc[at] == w.doc[at + size - 1]]:
                        d = int(w.doc[i])
                        places[d].append(int(i - w.first[d]))
                        base_labels[d].add(label)
                if n:
                    at = np.minimum(np.searchsorted(indexed, w.hash), len(indexed) - 1)
                    votes: dict[tuple[int, int, int], int] = {}
                    for i in np.flatnonzero(indexed[at] == w.hash):
                        d = int(w.doc[i])
                        for t, position in postings[int(w.hash[i])]:
                            where = (d, t, int(i - w.first[d]) - position)
                            votes[where] = votes.get(where, 0) + 1
                    for (d, t, place), count in sorted(votes.items()):
                        if count >= known[t][2] and (share := aligned(w, d, place, t)) >= coverage:
                            found[d].append({"label": templates[t][0], "word": place, "coverage": share})
                yield record(
                    _SCHEMA,
                    doc_id=ids[part.start : part.stop],
                    n_words=w.counts,
                    n_base=[len(p) for p in places],
                    first_word=[min(p, default=None) for p in places],
                    last_word=[max(p, default=None) for p in places],
                    base_labels=[",".join(sorted(x)) for x in base_labels],
                    labels=[",".join(sorted(x | {m["label"] for m in f})) for x, f in zip(base_labels, found)],
                    score=[1.0 if b else max((m["coverage"] for m in f), default=0.0) for b, f in zip(base_labels, found)],
                    matches=found,
                )

    return run


def license_scan(docs: DataFrame, base=BASE, templates=TEMPLATES, rare_words: int = RARE_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs: n_words, places of base phrases, labels, the best coverage as score, and all template matches."""
    postings, known = _plan(templates, word_rarity(docs, templates), rare_words)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(base, templates, postings, known, coverage), _DDL)
