"""Retrieval quality: run (query_id, doc_id, rank) against qrels (query_id, doc_id), all queries at once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import WORD
from quarry.operators import search
from quarry.operators.index import Index
from quarry.session import cut, join_checked, shuffle_partitions


def ranked(hits: DataFrame, score: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return hits.select("query_id", "doc_id", F.row_number().over(w).alias("rank"))


def judged(hits: DataFrame, score: str, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, rank): the first ``k`` hits of each query and its best relevant one, which is all of a run that ``per_query`` with
    cut-offs up to ``k`` looks at. Ranks are those of ``ranked``; the best relevant hit has the number of hits before it, so hits
    are never sorted as a whole. ``qrels``: cut."""
    hits = cut(hits.select("query_id", "doc_id", F.col(score).alias("_s")))
    first = ranked(hits, "_s").where(F.col("rank") <= k)
    w = W.partitionBy("query_id").orderBy(F.desc("_s"), "doc_id")
    relevant = join_checked(hits, qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    best = cut(relevant.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", F.col("doc_id").alias("_doc"), F.col("_s").alias("_best")))
    before = join_checked(hits, best, ["query_id"]).where("_s > _best OR (_s = _best AND doc_id < _doc)").groupBy("query_id").agg(F.count("*").alias("n"))
    placed = best.join(before, "query_id", "left").select("query_id", F.col("_doc").alias("doc_id"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"))
    return first.unionByName(placed.where(F.col("rank") > k))


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents (doc_id, text) that hold the passage of an item (query_id, passage). A passage is looked for only
    where its longest word that it holds as a whole stands; one without such a word is looked for everywhere."""
    words = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))
    inner = F.slice(words(F.col("passage")), 2, F.greatest(F.size(words(F.col("passage"))) - 2, F.lit(0)))  # the outer words may go on in a document
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = items.select("query_id", "passage", F.coalesce(longest, F.lit("")).alias("word"))
    asked = items.agg(F.collect_set("word").alias("asked"))  # one row
    met = F.array_intersect(F.array_append(words(F.col("text")), F.lit("")), F.col("asked"))
    rows = docs.crossJoin(F.broadcast(asked)).select("doc_id", "text", F.explode(met).alias("word"))
    return rows.join(F.broadcast(items), "word").where(F.contains("text", "passage")).select("query_id", "doc_id")


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, p_at_k, r_at_k, ndcg_at_k ..., rr) for every query that has judgements; nothing found counts 0."""
    rel = qrels.select("query_id", "doc_id").distinct()
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hit = run.join(rel, ["query_id", "doc_id"], "left_semi")
    parts = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        parts += [F.sum(inside.cast("int")).alias(f"hits_{k}"), F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}")]
    rows = sizes.join(hit.groupBy("query_id").agg(*parts), "query_id", "left")
    out = [F.col("query_id")]
    for k in ks:
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
        out += [(hits / float(k)).alias(f"p_at_{k}"), (hits / F.col("n_rel")).alias(f"r_at_{k}"), (F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal).alias(f"ndcg_at_{k}")]
    return rows.select(*out, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def macro(metrics: DataFrame) -> DataFrame:
    """Means over queries; the mean of ``rr`` is ``mrr``."""
    return metrics.agg(*[F.avg(c).alias("mrr" if c == "rr" else c) for c in metrics.columns if c != "query_id"])


def compare(index: Index, queries: DataFrame, qrels: DataFrame, k: int = 10, config: search.RankingConfig = search.RankingConfig()) -> DataFrame:
    """(method, p_at_5, p_at_10, r_at_10, mrr, ndcg_at_5, ndcg_at_10, average_latency_ms) of BM25 and of the ranking pipeline over queries
    (query_id, query), all in one job a method; the latency is a method's time over its queries."""
    asked = cut(queries.select("query_id", index.tokenizer.tokens("query").alias("terms")))
    n = max(1, asked.count())
    words = asked.select("query_id", F.explode("terms").alias("term")).distinct()
    out = None
    for method, hits in (("bm25", lambda: search.BM25().score_many(index, words).withColumnRenamed("bm25", "score")), ("ranking", lambda: search.rank_many(index, asked, config).withColumnRenamed("final", "score"))):
        began = time.perf_counter()
        run = ranked(hits(), "score")
        run = cut(run if method == "bm25" else run.where(F.col("rank") <= k))
        took = (time.perf_counter() - began) * 1000 / n
        row = macro(per_query(run, qrels, (5, 10))).select(F.lit(method).alias("method"), "p_at_5", "p_at_10", "r_at_10", "mrr", "ndcg_at_5", "ndcg_at_10", F.lit(took).alias("average_latency_ms"))
        out = row if out is None else out.unionByName(row)
    return out


def percentiles(rows: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(p, value) at index int(p * (n - 1)) of the sorted values, without interpolation: equal values are counted first, sums run
    inside sampled ranges of values, and the only window over all has a row a range."""
    spark = rows.sparkSession
    counted = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranged = cut(counted.repartitionByRange(shuffle_partitions(spark), value).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("size"))
    starts = sizes.select("_range", (F.sum("size").over(W.orderBy("_range")) - F.col("size")).alias("before"), F.sum("size").over(W.partitionBy()).alias("total"))
    inside = F.sum("n").over(W.partitionBy("_range").orderBy(value))
    upto = ranged.withColumn("inside", inside).join(F.broadcast(starts), "_range").select(value, (F.col("inside") + F.col("before")).alias("upto"), "total")
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in ps])).alias("p"))
    picked = upto.crossJoin(F.broadcast(wanted)).where(F.col("upto") > F.floor(F.col("p") * (F.col("total") - 1)))
    return picked.groupBy("p").agg(F.min(value).alias("value"))
