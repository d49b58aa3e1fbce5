"""Composite searches: what a search page shows, in one DataFrame a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import snippet
from quarry.operators import search
from quarry.operators.index import Index
from quarry.session import cut
from quarry.sources.settings import Settings, page_request


def _shown(rows: DataFrame, index: Index, query: str, score: str, request: tuple[int, int]) -> DataFrame:
    """The columns of a result list; the snippet is of the title, which is all that an index holds of a document's words in order."""
    s = snippet(F.coalesce("title", F.lit("")), index.tokenizer.python(query), 240)
    page, size = request
    return rows.select(
        F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total", "doc_id", F.col(score).alias("score"), "title", "url",
        s["text"].alias("snippet"), s["highlighted"].alias("highlighted"), "matched_terms", "explanation",
    )


def search_page(index: Index, query: str, page: int = 1, limit: int = 10, settings: Settings = Settings()) -> DataFrame:
    """A page of ranked hits, each with the number of all hits (0 rows beyond the last; ``search.count`` gives the number alone)."""
    query, limit, offset = page_request(query.strip(), page, limit, settings)
    hits = cut(search.rank(index, query))
    total = hits.agg(F.count("*").alias("total"))
    return _shown(search.page(hits, "final", limit, offset).crossJoin(F.broadcast(total)), index, query, "final", (page, limit))  # one row


def hybrid_page(index: Index, query: str, page: int = 1, limit: int = 10, settings: Settings = Settings()) -> DataFrame:
    """A page of hybrid hits, both weights 1; ``total`` is the number of rows of the page."""
    query, limit, offset = page_request(query.strip(), page, limit, settings, check_length=False)
    hits = search.hybrid(index, query, limit, offset, search.HybridConfig(1.0, 1.0))
    matched = search.BM25().score(index, query).select("doc_id", "matched_terms")
    rows = hits.join(matched, "doc_id", "left").join(index.documents.select("doc_id", "title", "url"), "doc_id", "left")
    rows = rows.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row
    said = F.create_map(*[x for c in ("bm25", "semantic", "final") for x in (F.lit(c), F.col(c))])
    none = F.array().cast("array<string>")
    return _shown(rows.withColumn("explanation", said).withColumn("matched_terms", F.coalesce("matched_terms", none)), index, query, "final", (page, limit))


def plain_page(index: Index, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """(doc_id, score, title, url, snippet, highlighted) of BM25 alone."""
    top = search.page(search.BM25().score(index, query), "bm25", limit, offset)
    rows = index.documents.join(F.broadcast(top), "doc_id", "right")  # at most ``limit`` rows
    s = snippet(F.coalesce("title", F.lit("")), index.tokenizer.python(query), 240)
    return rows.select("doc_id", F.col("bm25").alias("score"), "title", "url", s["text"].alias("snippet"), s["highlighted"].alias("highlighted"))


def rebuilt(documents: DataFrame) -> Index:
    """The index of all stored documents (doc_id, body, title, canonical_url, url)."""
    url = F.coalesce(F.when(F.col("canonical_url") != "", F.col("canonical_url")), F.col("url"), F.lit(""))
    return Index.build(documents.select("doc_id", F.coalesce("body", F.lit("")).alias("text"), F.coalesce("title", F.lit("")).alias("title"), url.alias("url")), dealt="term")
