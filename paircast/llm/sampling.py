"""A bounded sample of labelled documents for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paircast.llm.common import id_key


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """(text, y) of at most `rows_per_class` labelled documents of each class 0 and 1.

    Ids are taken in the order of a hash. A document with several labels has
    the largest; null labels, and labels of documents that are not there,
    count for nothing. Only the sampled ids, whose number is bounded, are
    broadcast to the documents, so texts are not shuffled.
    """
    known = labels.select(id_key().alias("_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("_id"), "_id"))
    chosen = known.withColumn("_n", rank).where(F.col("_n") <= rows_per_class).drop("_n")
    return docs.select(id_key().alias("_id"), "text").join(F.broadcast(chosen), "_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", F.xxhash64("_id", "text").alias("at"))
