"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Metric: seconds for all timed queries, each the second of two runs. Beside the seconds: index build throughput (tokenise, count, write to
Parquet), latency percentiles of single BM25 queries on the saved index, and queries a second of a batch in one job.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quarry.operators import search  # noqa: E402
from quarry.operators.index import Index  # noqa: E402
from quarry.plans.queries import QUERIES, _benchmark_queries  # noqa: E402
from quarry.session import importable, local_session, table  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TIMED = ("tokenize_counts", "postings", "index_stats", "bm25_topk", "bm25_multi_query", "rank_topk", "tfidf_weights", "hybrid_topk", "vector_topk", "content_hash", "duplicate_groups", "page_links", "crawl_bfs", "rate_limit", "stream_windows")


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    spark = local_session("bench", CPUS, int(CPUS))
    importable(spark)
    work = tempfile.mkdtemp(prefix="quarry-bench-")
    seconds: dict[str, float] = {}
    try:
        docs = table(spark, SF, "documents").select("doc_id", "text")
        n = docs.count()
        build = lambda: Index.build(docs, cleaned=True).save(f"{work}/index")
        build()
        seconds["index_build"] = timed(build)
        index = Index.load(spark, f"{work}/index")
        index = Index(index.postings.persist(), index.documents.persist(), index.tokenizer)
        index.postings.count(), index.documents.count()
        words = [r.term for r in index.term_df().orderBy(F.desc("df"), "term").limit(400).collect()][100:]
        one = lambda q: search.page(search.BM25().score(index, q), "bm25", 10).collect()
        one(f"{words[0]} {words[1]}")
        lat = sorted(timed(lambda i=i: one(f"{words[i]} {words[-i - 1]}")) for i in range(20))
        asked = _benchmark_queries(spark, SF)
        n_asked = asked.select("query_id").distinct().count()
        batch = lambda: search.BM25().score_many(index, asked).write.format("noop").mode("overwrite").save()
        batch()
        seconds["bm25_batch"] = timed(batch)
        index.postings.unpersist(), index.documents.unpersist()
        for name in TIMED:
            run = lambda name=name: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            run()
            seconds[name] = timed(run)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    at = lambda p: round(1000 * lat[int(p * (len(lat) - 1))], 1)
    print(
        json.dumps(
            {
                "metric": "seconds for all headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": SF,
                "index_docs_per_s": round(n / seconds["index_build"]),
                "bm25_ms": {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99)},
                "bm25_batch_queries_per_s": round(n_asked / seconds["bm25_batch"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
