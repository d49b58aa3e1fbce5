"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, fm_dedup, hnsw, html_main, jaccard_join, mixing, quality, suffix_dedup, toxicity
from quarry.llm.oracles import ORACLE_SQL
from quarry.session import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(0 AS BIGINT) turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]'"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    back = chat.read_back(chat.windows(rows))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    said, loss = F.array_join("w.said", ""), F.array_join("w.loss", "")
    add = lambda c: F.aggregate(F.col(f"w.{c}"), F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id",
        add("n").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        add("chars").alias("formatted_chars"),
    )


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), trainable=~held_out())
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = [rule for rule, _, _ in quality.plan(docs, given=quality.BASE)]
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    verdict = F.when(failed, False).otherwise(F.expr(quality.cascade(ordered, given=quality.BASE)))
    return quality.with_base(docs).select("doc_id", *quality.BASE, failed.alias("base_failed"), verdict.alias("kept"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_hnsw": op6_hnsw,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_html": op10_html,
}
