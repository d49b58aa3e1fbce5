"""Schemas of the stored tables, and their readers and sinks. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.store import latest

SCHEMAS = {
    "domains": "host string, allowed boolean, created_at timestamp",
    "documents": "doc_id long, url string, canonical_url string, title string, description string, body string, language string, content_hash string, title_length int, body_length int, last_crawled_at timestamp, crawl_status string",
    "document_links": "document_id long, target_url string, anchor_text string, position int",
    "crawl_jobs": "name string, seed_urls string, allowed_domains string, max_depth int, max_pages int, delay_seconds double, status string, pages_crawled int, pages_failed int, changed_at timestamp",
    "crawl_events": "job string, url string, status string, http_status int, error string, created_at timestamp",
    "index_metadata": "snapshot_name string, documents long, terms long, avg_document_length double, path string, created_at timestamp",
}


def init(spark: SparkSession, path: str) -> None:
    """Empty tables where there are none yet."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def append(rows: DataFrame, path: str, name: str) -> None:
    """Crawl events, job states and index records are appended; readers take the latest of a key."""
    rows.write.mode("append").parquet(f"{path}/{name}")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    return latest(read(spark, path, "crawl_jobs"), ["name"], ["changed_at"])


def index_records(spark: SparkSession, path: str) -> DataFrame:
    return latest(read(spark, path, "index_metadata"), ["snapshot_name"], ["created_at"])


def all_documents(docs: DataFrame, limit: int | None = None) -> DataFrame:
    rows = docs.orderBy("doc_id")
    return rows if limit is None else rows.limit(limit)


def by_doc_id(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def by_url(docs: DataFrame, url: str) -> DataFrame:
    return docs.where(F.col("canonical_url") == url)


def document_view(docs: DataFrame, links: DataFrame, doc_id: int) -> DataFrame:
    """One document with its link targets in order and no headings, which are not stored."""
    own = links.where(F.col("document_id") == doc_id).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "target_url"))), lambda x: x["target_url"]).alias("links"))
    return by_doc_id(docs, doc_id).crossJoin(F.broadcast(own)).withColumn("headings", F.array().cast("array<string>"))  # own is one row


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
