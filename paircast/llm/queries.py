"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paircast.llm import decontaminate, filter_audit, fingerprints, harmonic, infill, language, licenses, ngram_join, packing, quality, suffix_dedup, token_files, toxicity
from paircast.llm.common import held_out, read
from paircast.llm.oracles import SQL

Query = Callable[[SparkSession, str], DataFrame]


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read(spark, sf_dir, "documents")).drop("spans")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judged = language.identify(docs, docs.where(~held_out(5, 0)))
    return judged.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


#: The end of a document in the files of op 6.
END_ID = 2


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(read(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, token_files.token_folder(spark))
    return token_files.read_tokens(manifest)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = quality.fit(docs, read(spark, sf_dir, "labels").where(~held_out(5, 0)))
    scored = quality.scores(docs, machine)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held_out(3, 1)))
    scored = toxicity.scores(docs, scorer)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("matches")


def op11_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.harmonic_sequences(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprints, op2_pack, op3_ngram_join, op4_suffix_dedup, op5_language, op6_token_files, op7_quality, op8_toxicity, op9_decontaminate, op10_license_scan, op11_harmonic, op12_infill, op13_filter_audit, pipeline)}
ORACLES: dict[str, str] = dict(SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
