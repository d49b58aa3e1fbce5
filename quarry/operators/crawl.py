"""Crawling as a bounded breadth-first walk over pages and links that are tables already (no network)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.robots import decide
from quarry.functions.urls import blocked_name, host_of
from quarry.session import cut


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): what the seeds (url) reach over edges (source, target), each at its least depth. One join a level; levels are
    cut so that the plan does not grow, and the walk ends early when a level finds nothing new."""
    edges = cut(edges.select("source", "target").distinct())
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front.url == edges.source).select(F.col("target").alias("url")).distinct()
        front = cut(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def walk(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 100, hosts: DataFrame | None = None, robots: DataFrame | None = None, max_bytes: int = 2_000_000) -> DataFrame:
    """(url, depth, outcome): a bounded crawl over ``pages`` (url, status, html, title, body, links array<string>), whose URLs and links are
    in normal form, from ``seeds`` (url, seq). Levels are taken in order, and in a level the pages in the order in which their links
    were met. A URL is met if its host is allowed (``hosts``; null: all) and public; robots rules (``robots.rules``) skip it, a page that is
    not there fails, the other outcomes are those of ``gates``. Only fetched pages count against ``max_pages`` and lead on."""

    def met(urls: DataFrame) -> DataFrame:
        rows = urls.withColumn("host", host_of(F.col("url"))).where("url IS NOT NULL AND host <> ''").where(~blocked_name(F.col("host")))
        return allowed(rows, hosts).select("url", "seq")

    level = met(seeds.select("url", F.array(F.col("seq").cast("long")).alias("seq")))
    level = level.groupBy("url").agg(F.min("seq").alias("seq"))
    seen, left = None, max_pages
    for depth in range(max_depth + 1):
        if seen is not None:
            level = level.join(seen.select("url"), "url", "left_anti")
        judged = gates(level.join(pages, "url", "left"), max_bytes, body="html", text="body")
        judged = judged.withColumn("outcome", F.when(F.col("status").isNull(), "failed").otherwise(F.col("outcome")))
        if robots is not None:
            judged = decide(judged, robots).withColumn("outcome", F.when(F.col("allowed"), F.col("outcome")).otherwise("skipped"))
        judged = cut(judged.select("url", "seq", "outcome", "links"))
        fetched = judged.where("outcome = 'fetched'")
        n = fetched.count()
        if n > left:  # the crawl ends with the page that fills it
            end = fetched.orderBy("seq").limit(left).agg(F.max("seq").alias("end"))
            judged = judged.crossJoin(F.broadcast(end)).where(F.col("seq") <= F.col("end")).drop("end")  # one row
            fetched = judged.where("outcome = 'fetched'")
        now = judged.select("url", F.lit(depth).cast("long").alias("depth"), "outcome")
        seen = cut(now if seen is None else seen.unionByName(now))
        left -= min(n, left)
        if not n or not left:
            break
        targets = fetched.select("seq", F.posexplode("links").alias("at", "url")).select("url", F.concat("seq", F.array(F.col("at").cast("long"))).alias("seq"))
        level = met(targets.groupBy("url").agg(F.min("seq").alias("seq")))
    return seen


def gates(pages: DataFrame, max_bytes: int = 2_000_000, body: str = "body", text: str | None = None) -> DataFrame:
    """Adds ``outcome`` to (status, body, title): failed, too_large, skipped (neither text nor title), or fetched. ``text``: the column of
    the page's text, if it is not the body itself."""
    too_large = F.octet_length(F.coalesce(body, F.lit(""))) > max_bytes
    empty = (F.trim(F.coalesce(text or body, F.lit(""))) == "") & (F.coalesce("title", F.lit("")) == "")
    return pages.withColumn("outcome", F.when(F.col("status") >= 400, "failed").when(too_large, "too_large").when(empty, "skipped").otherwise("fetched"))


def allowed(urls: DataFrame, hosts: DataFrame | None, host: str = "host") -> DataFrame:
    """Rows whose host is in ``hosts`` (host); no list allows all."""
    return urls if hosts is None else urls.join(hosts.select(F.col("host").alias(host)), host, "left_semi")


def frontier_push(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """Adds (url, depth, seq) rows that are not there yet; first of equal ones wins; pop order is (depth, seq)."""
    first = found.groupBy("url").agg(F.min(F.struct("depth", "seq")).alias("f")).select("url", "f.depth", "f.seq")
    return frontier.unionByName(first.join(frontier.select("url"), "url", "left_anti"))


def frontier_pop(frontier: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows by (depth, seq), and the rest."""
    first = cut(frontier.orderBy("depth", "seq").limit(n))
    return first, frontier.join(F.broadcast(first.select("url")), "url", "left_anti")  # n rows


def statistics(events: DataFrame) -> DataFrame:
    """One row for a crawl's events (outcome, at, bytes): counts, seconds from first to last, pages a minute."""
    of = lambda x: F.coalesce(F.sum(F.col("outcome").isin(*x).cast("long")), F.lit(0))
    seconds = (F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))) / 1e6
    got = F.coalesce(F.sum(F.when(F.col("outcome") == "fetched", F.col("bytes"))), F.lit(0))
    one = events.agg(of(["fetched"]).alias("fetched"), of(["failed", "too_large"]).alias("failed"), of(["skipped"]).alias("skipped"), got.alias("bytes"), F.coalesce(seconds, F.lit(0.0)).alias("seconds"))
    return one.withColumn("pages_per_minute", F.when(F.col("seconds") > 0, F.col("fetched") * 60 / F.col("seconds")).otherwise(0.0))


def politeness(requests: DataFrame, delay_seconds: float) -> DataFrame:
    """Adds ``wait``: the seconds that a request (host, ts) must wait after the one before it at its host."""
    from pyspark.sql import Window as W

    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (ts - F.lag(ts).over(W.partitionBy("host").orderBy("ts"))) / 1e6
    return requests.withColumn("wait", F.greatest(F.lit(0.0), F.lit(delay_seconds) - F.coalesce(gap, F.lit(delay_seconds))))
