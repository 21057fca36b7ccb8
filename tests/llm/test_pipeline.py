import random

import corpus_pipeline
from corpora import CLASHING, awkward, frame, sentence
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as linked
from test_packing import check_ids, check_layout
from test_suffix_dedup import brute as repeats

import pyarrow as pa
from pyspark.sql import functions as F

from paircast.llm import decontaminate, language

#: What the stages call their own columns.
OWN_NAMES = ("_id", "_hash", "_copy", "_kept", "_language", "_row", "once", "kept")


def cut(text, others, window=400):
    """The text without 400-byte strings that start at two places of all texts."""
    b = (text or "").encode()
    gone = [False] * len(b)
    for p in range(len(b) - window + 1):
        if others[b[p : p + window]] > 1:
            gone[p : p + window] = [True] * window
    return bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    item = sentence(rng, 20, 10**5)
    docs = awkward() + [(40, sentence(rng, 30) + " " + item, "en"), (41, sentence(rng, 900) + " " + item, "en")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, item)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # The stages one after the other, each on what the one before kept.
    own = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    by_row = linked(own)
    keep, once = [], set()
    for d in own:
        component = next(c for i, n, c in by_row if i == d[0])
        if (component == d[0]) and (d[0], d[1]) not in once:
            once.add((d[0], d[1]))
            keep.append(d)
    count = {}
    for _, text, _ in keep:
        b = text.encode()
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
    keep = [(i, cut(t, count), lang) for i, t, lang in keep]
    bad = {r[0] for r in contaminated(keep, items) if r[5]}
    assert bad == {40}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_ids(rows, [(i, t) for i, t, _ in keep if i not in bad], 2048)
    check_layout(rows, 2048)
    assert repeats and CLASHING and decontaminate


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (frame(spark, awkward(), clash=True), frame(spark, [])):
            docs = docs.withColumns({c: F.lit("x") for c in OWN_NAMES})
            kept = stage(spark, docs, sf_dir)
            assert kept.columns == docs.columns, name
            for r in kept.collect():
                assert all(r[c] == "x" for c in OWN_NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, frame(spark, []), sf_dir).count() == 0


def test_numbers_and_signs_are_no_letters(spark):
    docs = frame(spark, [(i, t, None) for i, t in enumerate(["½ ² Ⅷ", "१२", "ª", "日本", "é"])])
    labelled = frame(spark, [(9, "some words of a language " * 9, "en"), (10, "quelques mots d'une langue " * 9, "fr")])
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, labelled).collect()}
    assert [got[i] == "und" for i in range(5)] == [True, True, False, False, False]


def test_registered():
    from paircast.llm.queries import ORACLES, QUERIES

    assert "pipeline" in QUERIES and "pipeline" not in ORACLES
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1


def test_long_texts_come_in_small_batches(spark, sf_dir):
    docs = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("long text "), 50000).alias("text"))

    def most(batches):
        yield pa.RecordBatch.from_pydict({"rows": pa.array([max(b.num_rows for b in batches)], pa.int64())})

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, frame(spark, []), sf_dir)
        assert docs.mapInArrow(most, "rows long").first()[0] <= 10, name
