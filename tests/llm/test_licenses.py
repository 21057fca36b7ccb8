import re

from corpora import awkward, frame

from paircast.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


EXTRA = [
    (40, "Released Under the MIT License. Again: under the mit-license!", "en"),
    (41, "Licensed under the Apache License, Version 2.0 and CC-BY-NC", "en"),
    (42, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "en"),
    (43, "Permission was kindly granted, free of charge, to any person", "en"),
    (44, "x GNU General Public License, version 3 y", "en"),
    (45, "under the mit", "en"),
    (46, "license under the", "en"),
]


def test_base_against_brute_force_and_templates(spark):
    docs = awkward() + EXTRA
    rows = licenses.license_scan(frame(spark, docs, clash=True)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((d[0], *brute(d[1])) for d in docs), key=repr)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[42] == "mit" and labels[43] == "" and labels[44] == "gpl-3"
    assert labels[41] == "apache-2,cc-by-nc"
    assert all(0 <= r.score <= 1 for r in rows)


def test_empty(spark):
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_license_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
