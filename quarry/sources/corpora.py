"""Corpora made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic(spark: SparkSession, n: int, vocabulary: list[str], words: int = 11) -> DataFrame:
    """(doc_id, url, title, text) for i = 1 ... n: word j of document i is number i * j modulo the vocabulary's size."""
    v = F.array(*[F.lit(w) for w in vocabulary])
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda j: F.element_at(v, ((F.col("doc_id") * j) % len(vocabulary) + 1).cast("int"))), " ")
    d = spark.range(1, n + 1).withColumnRenamed("id", "doc_id")
    return d.select("doc_id", F.concat(F.lit("https://example.com/"), "doc_id").alias("url"), F.concat(F.lit("Document "), "doc_id").alias("title"), text.alias("text"))
