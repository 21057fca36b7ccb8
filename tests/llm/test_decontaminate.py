import hashlib
import re

import pytest
from corpora import awkward, frame, sentence

from paircast.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        wins += [(str(item) if item is not None else "null", tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text, _ in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        names = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables(spark):
    import random

    rng = random.Random(3)
    docs = [r for r in awkward() if r[0] != 20]
    item = sentence(rng, 20)
    docs += [
        (30, "before " + item.upper().replace(" ", ", ") + " after", "en"),
        (31, sentence(rng, 900) + " " + item + " " + item, "en"),
        (32, "Short Answer, twice: short answer", "en"),
        (33, "half " + " ".join(item.split()[:12]), "en"),
    ]
    items = [(1, item), (2, "short answer"), (3, None), (4, "... "), (5, item), (None, sentence(rng, 14)), (10, "one"), (2, "short answer")]
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [500_000, 7])
def test_against_brute_force(spark, block):
    docs, items, benchmark = tables(spark)
    got = decontaminate.contamination(frame(spark, docs, clash=True), benchmark, block=block)
    rows = sorted((tuple(r[:6]) for r in got.collect()), key=repr)
    assert rows == brute(docs, items)


def test_filter_keeps_columns_and_repeats(spark):
    docs, items, benchmark = tables(spark)
    df = frame(spark, docs, clash=True)
    kept = decontaminate.without_contaminated(df, benchmark)
    assert kept.columns == df.columns
    bad = {r[0] for r in brute(docs, items) if r[5]}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_empty_tables_and_spans(spark):
    docs, _, benchmark = tables(spark)
    assert decontaminate.contamination(frame(spark, docs), benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []), benchmark).count() == 0
    assert decontaminate.cut_spans("Keep this, DROP THAT, keep", [2, 4]) == "Keep this, , keep"
    assert decontaminate.cut_spans(None, []) is None


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    wins = {}
    for r in items:
        w = words(r.text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(r.item_id))
    want = {}
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for k in range(len(w)):
            if own := wins.get(tuple(w[k : k + 13])):
                hit.update(range(k, k + 13))
                found |= own
        want[d.doc_id] = (len(w), len(hit), ",".join(sorted(found)))
    for r in QUERIES["op9_decontaminate"](spark, sf_dir).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.items_sha256) == (n, hit, hashlib.sha256(found.encode()).hexdigest())
