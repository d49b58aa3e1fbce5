"""The inverted index as three tables: postings, documents, one row of statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import Tokenizer, clean, uses
from quarry.session import cut


_LINE = "term string, postings array<struct<doc_id: long, tf: long, positions: array<long>>>, doc_id long, url string, title string, doc_length long, title_length long"


@dataclass(frozen=True)
class Index:
    """``postings``: term, doc_id, tf (and positions, if asked for); ``documents``: doc_id, url, title, doc_length, title_length.
    Titles are never in the postings."""

    postings: DataFrame
    documents: DataFrame
    tokenizer: Tokenizer = Tokenizer()

    @staticmethod
    def build(docs: DataFrame, tokenizer: Tokenizer | None = None, text: str = "text", cleaned: bool = False, positions: bool = False, dealt: str | None = None) -> Index:
        """From (doc_id, text[, url, title]). ``cleaned``: texts are in NFKC without character references already.
        Terms are counted per document before they are shuffled by both. ``dealt`` (term or doc_id), for what reads all postings: tokens are
        shuffled once by this column alone, and joins and groups by it need no other exchange. Rows of a term are at most its tokens."""
        tok = tokenizer or Tokenizer()
        if not cleaned:  # else texts are tokenised as they are
            docs = clean(docs, text, *(["title"] if "title" in docs.columns else []))
        url = F.col("url") if "url" in docs.columns else F.lit("")
        title = F.col("title") if "title" in docs.columns else F.lit("")
        documents = docs.select("doc_id", url.alias("url"), title.alias("title"), F.size(tok.tokens(text)).cast("long").alias("doc_length"), F.size(tok.tokens(title)).cast("long").alias("title_length"))
        if positions:
            postings = tok.stream(docs, text).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
        else:
            tokens = docs.select("doc_id", F.explode(tok.tokens(text)).alias("term"))
            postings = (tokens.repartition(dealt) if dealt else tokens).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
        return Index(postings, documents, tok)

    def stats(self) -> DataFrame:
        """One row: num_documents, num_terms, total_postings, total and average document length (0 if empty)."""
        d = self.documents.agg(F.count("*").alias("num_documents"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("total_document_length"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_document_length"))
        p = self.term_df().agg(F.count("*").alias("num_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"))
        return d.crossJoin(p).select("num_documents", "num_terms", "total_postings", "total_document_length", "avg_document_length")

    def term_df(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def vocabulary(self) -> DataFrame:
        return self.postings.select("term").distinct()

    def add(self, docs: DataFrame, text: str = "text", cleaned: bool = False) -> Index:
        """With more documents; an id that is already there is an error."""
        if docs.join(self.documents, "doc_id", "left_semi").limit(1).count():
            raise ValueError("a doc_id is indexed already")
        more = Index.build(docs, self.tokenizer, text, cleaned, "positions" in self.postings.columns)
        return Index(self.postings.unionByName(more.postings), self.documents.unionByName(more.documents), self.tokenizer)

    def remove(self, ids: DataFrame) -> Index:
        """Without the documents of ``ids`` (doc_id); unknown ids change nothing."""
        return Index(self.postings.join(ids, "doc_id", "left_anti"), self.documents.join(ids, "doc_id", "left_anti"), self.tokenizer)

    def persisted(self) -> Index:
        return Index(cut(self.postings), cut(self.documents), self.tokenizer)

    def save(self, path: str) -> None:
        """Snapshot: postings sorted by term in files by range of terms, so a query's terms prune row groups; documents; statistics."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.stats().write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str, tokenizer: Tokenizer | None = None) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"), tokenizer or Tokenizer())

    def matched_positions(self, terms: list[str]) -> DataFrame:
        """(doc_id, positions): where any of the terms stands in each document, in order; the index must have positions."""
        found = self.postings.where(F.col("term").isin(*uses(terms)))
        return found.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))

    @staticmethod
    def from_json(lines: DataFrame, tokenizer: Tokenizer | None = None) -> Index:
        """From the lines (value) of ``to_json``, in any order. Quotes inside a string are escaped, so the bare key tells the two kinds of
        lines apart before any is parsed, and each kind is parsed once."""
        listed = F.contains("value", F.lit('"postings":['))
        rows = lines.select(F.from_json("value", _LINE).alias("v"), listed.alias("listed"))
        if not lines.where(listed & F.contains("value", F.lit('"positions":['))).limit(1).count():
            rows = lines.select(F.from_json("value", _LINE.replace(", positions: array<long>", "")).alias("v"), listed.alias("listed"))
        postings = rows.where("listed").select("v.term", F.explode("v.postings").alias("p")).select("term", "p.*")
        return Index(postings, rows.where("NOT listed").select(*[f"v.{c}" for c in ("doc_id", "url", "title", "doc_length", "title_length")]), tokenizer or Tokenizer())

    def to_json(self) -> DataFrame:
        """One JSON line for each document, and one for each term and range of 65,536 doc_ids, so that no line grows without bound."""
        return self.json_lines().select("value")

    def json_lines(self) -> DataFrame:
        """(term, doc_id, value): the lines with the term or the document that each is of."""
        p = self.postings.groupBy("term", F.floor(F.col("doc_id") / 65_536).alias("_range")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in self.postings.columns if c != "term"]))).alias("postings"))
        none = lambda kind: F.lit(None).cast(kind)
        terms = p.select("term", none("long").alias("doc_id"), F.to_json(F.struct("term", "postings")).alias("value"))
        return terms.unionAll(self.documents.select(none("string").alias("term"), "doc_id", F.to_json(F.struct("*")).alias("value")))
