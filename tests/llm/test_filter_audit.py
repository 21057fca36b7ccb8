import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from corpora import awkward, frame, sentence
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paircast.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text):
    words = WORD.findall(text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return out + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def by_force(docs, labels):
    """docs: (doc_id, text, source); row by row, order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        again = i is not None and any((u or "") == (text or "") and j is not None and j < i for j, u, _ in docs)
        rows.append((source or "", failed(text or "") + "E" * again, i in good, i in toxic))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, q, t in rows:
            gone = False
            for k, name in enumerate(order, 1):
                cell = out[part, order, k]
                cell[0] += not gone and name not in fails
                cell[1] += not gone and name in fails
                cell[2] += gone and name in fails
                cell[3] += fails == name
                cell[4] += not gone and name in fails and q
                cell[5] += not gone and name in fails and t
                gone |= name in fails
    for (part, order, k), cell in out.items():
        shapley[part, order[k - 1]] += cell[1]
    return {key: (*cell, shapley[key[0], key[1][key[2] - 1]]) for key, cell in out.items()}


def corpus():
    rng = random.Random(8)
    docs = [(i, t, None if n % 3 else "src0") for n, (i, t, _) in enumerate(awkward())]
    shared = sentence(rng, 250, 60)
    for i in range(200, 260):
        docs.append((i, rng.choice([shared, sentence(rng, 210, 5000), sentence(rng, 20).upper(), "100% of it", None, ""]), rng.choice(["a", "b", "", None])))
    docs += [docs[-1], (None, shared, "a"), (None, None, "b"), (250, "other text of the same id", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(190, 240)] + [(200, 1, 0), (200, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def tables(spark, docs, labels):
    d = frame(spark, [(i, t, "en") for i, t, _ in docs], clash=True).drop("source")
    keyed = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    keyed = keyed.withColumns({c: F.lit("x") for c in (*d.columns[4:], "mask", "part", "page", "digest", "_id", "n")})
    return keyed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("_id", F.lit("x"))


@pytest.mark.parametrize("broadcast_pages", [filter_audit.BROADCAST_PAGES, 0])
def test_counts_by_force(spark, broadcast_pages):
    docs, labels = corpus()
    rows = filter_audit.interaction_audit(*tables(spark, docs, labels), broadcast_pages).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) == 4 * 600  # '', a, b, src0
    assert got == by_force(docs, labels)


def test_the_sketch_clears_most_unique_texts_and_no_repeat(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 100 == 7, F.lit(-1)).otherwise(F.col("id"))).alias("text"), F.lit("s").alias("source"))
    flags = filter_audit.text_flags(docs).cache()
    left = filter_audit.possible_repeats(docs, flags)
    n = left.count()
    assert left.where("text = 'text -1'").count() == 300
    assert 300 < n < 300 + 0.06 * 30000
    assert filter_audit.repeats(docs, flags).count() == 299


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "\n", "\x0b", "\x1c", "\x85", " ", "é", "𝄞", "#", "word ", "A" * 9]), max_size=40).map("".join))
def test_flags_of_a_text(text):
    for limit in (filter_audit.WORDS_BYTES, 3):
        filter_audit.WORDS_BYTES, old = limit, filter_audit.WORDS_BYTES
        try:
            assert filter_audit.text_mask(text.encode()) == sum(filter_audit.BIT[x] for x in failed(text))
        finally:
            filter_audit.WORDS_BYTES = old


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interaction_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, source string")
    rows = filter_audit.interaction_audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120
