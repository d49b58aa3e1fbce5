"""A training corpus from ``documents``: toxic documents go, one document of each near-duplicate group stays, repeated passages are
cut, sources are mixed to target weights, and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but
the last keep the columns of ``documents``; nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, fm_dedup, jaccard_join, mixing, toxicity
from quarry.session import cut, importable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from all labels of the stage's documents."""
    importable(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the least doc_id."""
    importable(spark)
    return jaccard_join.representatives(docs, words=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that start in a document with a smaller doc_id are cut out; documents stay."""
    importable(spark)
    return fm_dedup.cleaned(docs, length=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; sources weigh 1, 2, 3, repeating."""
    importable(spark)
    return mixing.repeated_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian 32-bit integers, and what they decode to."""
    import public_tokenizers

    importable(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, ranks, pattern).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_passages),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier of the first stage is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
