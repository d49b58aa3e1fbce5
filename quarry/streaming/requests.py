"""Request streams: the greedy rate limit (batch and streaming) and, as an extension, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S = 60.0


def _admit(stamps: list[float], kept: list[float], limit: int) -> tuple[list[bool], list[float]]:
    """Greedy: stamps of 60 s or more ago are dropped; at the limit a request is turned away and leaves no stamp."""
    out = []
    for t in stamps:
        kept = [k for k in kept if t - k < WINDOW_S]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out, kept


def rate_limit(requests: DataFrame, limit: int = 120, client: str = "user_id") -> DataFrame:
    """(event_id, client, allowed) for each request (event_id, client, ts). A client's requests meet in ts order; the state kept is
    at most ``limit`` stamps, and rows stream through in sorted partitions, so a busy client needs no memory of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for b in batches:
            allowed = []
            for c, t in zip(b["client"].tolist(), b["t"].tolist()):
                if c != now:
                    now, kept = c, []
                ok, kept = _admit([t], kept, limit)
                allowed += ok
            yield pd.DataFrame({"event_id": b["event_id"], client: b["client"], "allowed": allowed})

    rows = requests.select("event_id", F.col(client).cast("long").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows.repartition("client").sortWithinPartitions("client", "t", "event_id").mapInPandas(run, f"event_id long, {client} long, allowed boolean")


def rate_limit_stream(requests: DataFrame, limit: int = 120, client: str = "user_id") -> DataFrame:
    """The same on a stream: the stamps of the last minute are each client's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for b in batches:
            b = b.sort_values(["t", "event_id"])
            ok, kept = _admit(b["t"].tolist(), kept, limit)
            yield pd.DataFrame({"event_id": b["event_id"], client: key[0], "allowed": ok})
        state.update((kept,))

    rows = requests.select("event_id", F.col(client).cast("long").alias(client), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(client).applyInPandasWithState(run, f"event_id long, {client} long, allowed boolean", "stamps array<double>", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of (ts, event_type, value) by window; on a stream late rows beyond the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", watermark)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", client: str = "user_id") -> DataFrame:
    """Extension: sessions of a client by inactivity gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", gap)
    return e.groupBy(F.session_window("ts", gap).alias("w"), client).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), client, "n")


def sync_batch(path: str, tokenizer=None):
    """A foreachBatch function that logs a stream of documents (doc_id, text, url, title) for the index. Each micro-batch writes the
    postings of its own documents under its epoch, and then the documents, which make them count; nothing that is there is rewritten,
    and an epoch that runs again replaces itself. Of several rows of a doc_id in one batch any one counts."""
    from quarry.operators.index import Index

    def sync(batch: DataFrame, epoch: int) -> None:
        made = Index.build(batch.dropDuplicates(["doc_id"]), tokenizer).persisted()
        made.postings.write.mode("overwrite").parquet(f"{path}/postings/epoch={epoch}")
        made.documents.write.mode("overwrite").parquet(f"{path}/documents/epoch={epoch}")

    return sync


def synced_index(spark: SparkSession, path: str, tokenizer=None):
    """The index that the log of ``sync_batch`` stands for: of each document its last epoch."""
    from quarry.functions.text import Tokenizer
    from quarry.operators.index import Index

    documents = spark.read.parquet(f"{path}/documents")
    last = documents.groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    postings = spark.read.parquet(f"{path}/postings").join(last, ["doc_id", "epoch"], "left_semi").drop("epoch")
    return Index(postings.select("term", "doc_id", "tf"), documents.join(last, ["doc_id", "epoch"], "left_semi").drop("epoch"), tokenizer or Tokenizer())
