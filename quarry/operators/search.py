"""Ranked search over an index: BM25, ranking signals, hybrid with TF-IDF cosine, pages of results, suggestions.

Queries are a DataFrame (query_id, terms) where many are asked at once, or a string. Query terms are few and are broadcast against the
postings after a check of their size; everything else is a join or an aggregate that grows with the matching postings only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import snippet, uses
from quarry.operators.index import Index
from quarry.session import cut

#: Queries of a batch up to this many terms in all are broadcast.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be at least 0 and b between 0 and 1")

    def contributions(self, index: Index, queries: DataFrame, few: bool = False) -> DataFrame:
        """(query_id, doc_id, term, score) for queries (query_id, term), each term once. ``few``: known to be few terms."""
        terms = queries.select("query_id", "term").distinct()
        small = few or terms.count() <= BROADCAST_TERMS
        side = F.broadcast if small else lambda x: x
        found = index.postings.select("term", "doc_id", "tf").join(side(terms.select("term").distinct()), "term", "left_semi")  # goes below the count of tokens
        df = found.groupBy("term").agg(F.count("*").alias("df"))  # a posting is there once a term and document
        lengths = index.documents.select("doc_id", "doc_length")
        lengths = lengths if few else cut(lengths)  # read twice; the join's own filter would keep Spark from sharing them
        n = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"))
        rows = found.join(side(df), "term").join(lengths.hint("shuffle_hash"), "doc_id", "left").crossJoin(F.broadcast(n))  # n is one row
        avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
        dl = F.greatest(F.coalesce("doc_length", F.lit(1)), F.lit(1))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        score = idf * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * dl / avgdl))
        return rows.select("doc_id", "term", score.alias("score")).join(side(terms), "term").select("query_id", "doc_id", "term", "score")

    def score_many(self, index: Index, queries: DataFrame, few: bool = False) -> DataFrame:
        """(query_id, doc_id, bm25, matched_terms), only documents with a score above 0."""
        c = self.contributions(index, queries, few)
        return c.groupBy("query_id", "doc_id").agg(F.sum("score").alias("bm25"), F.sort_array(F.collect_set("term")).alias("matched_terms")).where("bm25 > 0")

    def score(self, index: Index, query: str) -> DataFrame:
        """(doc_id, bm25, matched_terms) of one query. Its terms are a filter on the postings, which a saved index prunes files by."""
        terms = uses(index.tokenizer.python(query))
        asked = Index(index.postings.where(F.col("term").isin(*terms)), index.documents, index.tokenizer)
        return self.score_many(asked, one_query(index.postings.sparkSession, terms), few=True).drop("query_id")


def one_query(spark: SparkSession, terms: list[str]) -> DataFrame:
    rows = F.array(*[F.lit(t) for t in uses(terms)]).cast("array<string>")
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.explode(rows).alias("term"))


def page(hits: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of hits by score, ties by doc_id. A limit of 0 or less is an empty page; a negative offset is an error."""
    if offset < 0:
        raise ValueError("offset must be at least 0")
    if limit <= 0:
        return hits.limit(0)
    return hits.orderBy(F.desc(order), "doc_id").offset(offset).limit(limit)


@dataclass(frozen=True)
class RankingConfig:
    """Weights of the signals; one of weight 0 is left out."""

    bm25: float = 1.0
    title: float = 1.5
    url: float = 0.5
    freshness: float = 0.3
    quality: float = 0.3

    @staticmethod
    def balanced() -> RankingConfig:
        return RankingConfig()

    @staticmethod
    def bm25_only() -> RankingConfig:
        return RankingConfig(1.0, 0.0, 0.0, 0.0, 0.0)

    def without(self, *signals: str) -> RankingConfig:
        return replace(self, **dict.fromkeys(signals, 0.0))


def title_signal(index: Index, terms: list[str]) -> Column:
    """Share of the query's terms, repeated ones included, that are title tokens."""
    if not terms:
        return F.lit(0.0)
    tokens = index.tokenizer.tokens("title")
    hit = sum((F.array_contains(tokens, t).cast("int") for t in terms), F.lit(0))
    return F.when(F.size(tokens) > 0, hit / F.lit(float(len(terms)))).otherwise(0.0)


def url_signal(terms: list[str]) -> Column:
    """Share of the query's terms that are substrings of the URL."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce("url", F.lit("")))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def quality_signal() -> Column:
    """Logistic of the length against the average; 0 for empty documents, 0.5 in an empty index."""
    ratio = F.col("doc_length") / F.when(F.col("avgdl") > 0, F.col("avgdl"))
    return F.when(F.col("avgdl") <= 0, 0.5).when(F.col("doc_length") <= 0, 0.0).otherwise(1.0 / (1.0 + F.exp(-(ratio - 1.0))))


def rank(index: Index, query: str, config: RankingConfig = RankingConfig(), signals: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, url, title, bm25, title_score ..., final, explanation, matched_terms) for all hits of BM25 with its default parameters.
    ``signals`` replaces a signal's expression over documents (doc_id, url, title, doc_length, title_length, avgdl)."""
    terms = index.tokenizer.python(query)
    hits = BM25().score(index, query)
    avgdl = index.documents.agg(F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"))
    rows = hits.join(index.documents, "doc_id", "left").crossJoin(F.broadcast(avgdl))  # one row
    made = {"title": title_signal(index, terms), "url": url_signal(terms), "freshness": F.lit(0.5), "quality": quality_signal()} | (signals or {})
    weights = {k: getattr(config, k) for k in made if getattr(config, k, 0.0)}
    rows = rows.withColumns({f"{k}_score": made[k] for k in weights})
    final = config.bm25 * F.col("bm25")
    for k, w in weights.items():
        final = final + w * F.col(f"{k}_score")
    rows = rows.withColumn("final", final)
    said = F.map_from_arrays(F.array(*[F.lit(k) for k in ("bm25", "final", *weights)]), F.array(F.col("bm25"), F.col("final"), *[F.col(f"{k}_score").cast("double") for k in weights]))
    return rows.select("doc_id", "url", "title", "bm25", *[f"{k}_score" for k in weights], "final", said.alias("explanation"), "matched_terms")


def rank_many(index: Index, queries: DataFrame, config: RankingConfig = RankingConfig()) -> DataFrame:
    """(query_id, doc_id, bm25, final) of queries (query_id, terms array<string>), as ``rank`` has them for one."""
    words = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    avgdl = index.documents.agg(F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"))
    rows = BM25().score_many(index, words).join(queries.select("query_id", "terms"), "query_id").join(index.documents, "doc_id").crossJoin(F.broadcast(avgdl))  # one row
    asked = F.size("terms")
    tokens, low = index.tokenizer.tokens("title"), F.lower(F.coalesce("url", F.lit("")))
    title = F.when(F.size(tokens) > 0, F.size(F.filter("terms", lambda t: F.array_contains(tokens, t))) / asked).otherwise(0.0)
    url = F.size(F.filter("terms", lambda t: F.contains(low, t))) / asked
    final = config.bm25 * F.col("bm25") + config.title * title + config.url * url + config.freshness * F.lit(0.5) + config.quality * quality_signal()
    return rows.select("query_id", "doc_id", "bm25", final.alias("final"))


def clamped_ratio(value: Column, ceiling: Column) -> Column:
    """``value`` as a share of ``ceiling``, from 0 to 1; 0 where the ceiling is not above 0."""
    return F.when(ceiling <= 0, 0.0).otherwise(F.least(F.greatest(value / ceiling, F.lit(0.0)), F.lit(1.0)))


def signal_json(value: Column, raw: Column | None = None) -> Column:
    """A signal as JSON: its score, and what it was made of if that is known."""
    return F.to_json(F.struct(value.alias("score"), *([raw.cast("double").alias("raw")] if raw is not None else [])))


def retrieve(index: Index, query: str, docs: DataFrame, limit: int = 10, offset: int = 0, bm25: BM25 = BM25(), max_length: int = 240) -> DataFrame:
    """A page of hits with url, title and a highlighted snippet of the body. Bodies are joined after the page is cut, so only as
    many are looked at."""
    terms = index.tokenizer.python(query)
    top = page(bm25.score(index, query), "bm25", limit, offset)
    rows = docs.join(F.broadcast(top), "doc_id", "right")  # at most `limit` rows
    s = snippet(F.col("text"), terms, max_length)
    return rows.select("doc_id", "bm25", "matched_terms", s["text"].alias("snippet"), s["highlighted"].alias("highlighted"))


def count(index: Index, query: str, bm25: BM25 = BM25()) -> DataFrame:
    return bm25.score(index, query).agg(F.count("*").alias("total"))


def suggestions(index: Index, prefix: str, limit: int = 10) -> DataFrame:
    """The first terms of the vocabulary that share three characters with the last word of the prefix."""
    words = index.tokenizer.python(prefix)
    if not words:
        return index.vocabulary().limit(0).select(F.col("term").alias("suggestion"))
    last = words[-1]
    found = index.vocabulary().where(F.col("term").startswith(last[:3]) & (F.col("term") != last)).orderBy("term").limit(limit)
    return found.select(F.concat_ws(" ", F.lit(prefix), "term").alias("suggestion"))


# TF-IDF vectors stay sparse: rows (doc_id, term, weight) of unit length.


def _raw_weights(index: Index) -> DataFrame:
    """(doc_id, term, w): (1 + ln tf)(ln((n + 1) / (df + 1)) + 1). A partition's terms are hashed, so its postings need no sort."""
    n = index.documents.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    raw = index.postings.join(index.term_df().hint("shuffle_hash"), "term").crossJoin(F.broadcast(n))
    return raw.select("doc_id", "term", ((1.0 + F.log("tf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0)).alias("w"))


def tfidf(index: Index) -> DataFrame:
    """(doc_id, term, weight): the raw weights, L2-normed for each document."""
    w = _raw_weights(index)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return w.select("doc_id", "term", (F.col("w") / F.when(norm > 0, norm).otherwise(1.0)).alias("weight"))


def tfidf_by_document(index: Index) -> DataFrame:
    """(doc_id, n_terms, max_weight, sum_weight) of ``tfidf``: a document's weights share one norm, which divides their maximum and sum."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    norm = F.when(norm > 0, norm).otherwise(1.0)
    return _raw_weights(index).groupBy("doc_id").agg(F.count("*").alias("n_terms"), (F.max("w") / norm).alias("max_weight"), (F.sum("w") / norm).alias("sum_weight"))


def cosine_to_query(index: Index, query: str) -> DataFrame:
    """(doc_id, semantic) of documents that share a term with the query; all others have 0. A document's norm and its product with the query
    are sums of one pass."""
    terms = index.tokenizer.python(query)
    tf = {t: terms.count(t) for t in set(terms)}
    spark = index.postings.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("qtf")) for t, c in sorted(tf.items())]).cast("array<struct<term:string,qtf:int>>")).alias("q")).select("q.*")
    n = index.documents.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    df = index.postings.where(F.col("term").isin(*tf)).groupBy("term").agg(F.count("*").alias("df"))
    q = asked.join(df, "term").crossJoin(F.broadcast(n)).select("term", ((1.0 + F.log("qtf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0)).alias("qw"))
    norm = q.agg(F.sqrt(F.coalesce(F.sum(F.col("qw") * F.col("qw")), F.lit(0.0))).alias("qn"))
    sums = _raw_weights(index).join(F.broadcast(q), "term", "left").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.col("qw")).alias("wq"))
    over = lambda x: F.when(x > 0, x).otherwise(1.0)
    return sums.where("wq IS NOT NULL").crossJoin(F.broadcast(norm)).select("doc_id", (F.col("wq") / over(F.sqrt("ww")) / over(F.col("qn"))).alias("semantic"))


@dataclass(frozen=True)
class HybridConfig:
    bm25: float = 1.0
    semantic: float = 0.5
    title: float = 0.0


def hybrid(index: Index, query: str, limit: int = 10, offset: int = 0, config: HybridConfig = HybridConfig()) -> DataFrame:
    """A page of (doc_id, bm25, semantic, final): BM25 over its maximum and TF-IDF cosine, weighted. Semantic candidates are the best
    max(4 * limit, 50), documents without similarity included, ties by doc_id."""
    if limit <= 0 or offset < 0:
        return index.documents.select("doc_id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("semantic"), F.lit(0.0).alias("final")).limit(0)
    similar = cut(cosine_to_query(index, query))  # else the join's filter on doc_id goes below one of the two uses of the postings
    near = index.documents.select("doc_id").join(similar, "doc_id", "left").select("doc_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    near = near.orderBy(F.desc("semantic"), "doc_id").limit(max(4 * limit, 50))
    hits = cut(BM25().score(index, query).select("doc_id", "bm25"))  # read twice
    top = hits.agg(F.coalesce(F.max("bm25"), F.lit(1.0)).alias("top"))
    both = hits.join(near, "doc_id", "full_outer").crossJoin(F.broadcast(top))
    rows = both.select("doc_id", (F.coalesce("bm25", F.lit(0.0)) / F.col("top")).alias("bm25"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    final = config.bm25 * F.col("bm25") + config.semantic * F.col("semantic")
    if config.title:
        rows = rows.join(index.documents.select("doc_id", "title"), "doc_id", "left").withColumn("title_score", title_signal(index, index.tokenizer.python(query))).drop("title")
        final = final + config.title * F.col("title_score")
    return page(rows.withColumn("final", final), "final", limit, offset)


# Dense vectors.


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length, 0 if either is zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vectors_upsert(stored: DataFrame, incoming: DataFrame, key: str = "vec_id") -> DataFrame:
    """Stored vectors with those of ``incoming`` (one row a key) in place of their own."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def vectors_remove(stored: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """Without the vectors of ``ids``; unknown ids change nothing."""
    return stored.join(ids.select(key), key, "left_anti")


def vectors_get(stored: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_semi")


def vector_topk(vectors: DataFrame, query_id: int, limit: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): the vectors nearest to one of them by cosine, itself left out, ties by key."""
    q = vectors.where(F.col(key) == query_id).select(F.col(vector).alias("_q")).limit(1)
    rows = vectors.where(F.col(key) != query_id).crossJoin(F.broadcast(q))  # one row
    return rows.select(key, cosine(F.col(vector), F.col("_q")).alias("score")).orderBy(F.desc("score"), key).limit(limit)
