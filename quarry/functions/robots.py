"""robots.txt as tables: files become ordered rules of one agent, and URLs meet their host's rules in a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.urls import host_of
from quarry.session import join_checked

_LINE = r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$"
_KINDS = ("user-agent", "allow", "disallow", "crawl-delay", "request-rate")


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rules, crawl_delay) from files (host, body): the rules of ``agent`` as (path, allow) in the file's order, and its delay in
    seconds or null.

    A group is one or more User-agent lines and the lines up to the next such run; it counts if it has a line of its own. The first
    group that names a part of the agent's product token holds, else the first group for everyone (*). The delay is the last one that
    stands under a User-agent line for everyone or for the agent. A host without rules has an empty list."""
    token = agent.split("/")[0].lower()
    lines = files.select(F.lower("host").alias("host"), F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("host", "at", F.lower(F.regexp_extract("line", _LINE, 1)).alias("kind"), F.regexp_extract("line", _LINE, 2).alias("value")).where(F.col("kind").isin(*_KINDS))
    file = W.partitionBy("host").orderBy("at")  # one file at a time
    names = F.col("kind") == "user-agent"
    lines = lines.withColumn("opens", names & (F.coalesce(F.lag("kind").over(file), F.lit("")) != "user-agent"))
    lines = lines.withColumn("group", F.sum(F.col("opens").cast("int")).over(file)).withColumn("under", F.last(F.when(names, F.lower("value")), ignorenulls=True).over(file)).where("group > 0")
    named = F.lit(token).contains(F.lower("value"))
    groups = lines.groupBy("host", "group").agg(
        F.max(names & (F.col("value") == "*")).alias("all"), F.max(names & named).alias("own"), F.max(~names).alias("full"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("allow", "disallow"), F.struct("at", F.col("value").alias("path"), ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"))))).alias("lines"),
    )
    chosen = groups.where(F.col("full") & (F.col("all") | F.col("own"))).groupBy("host").agg(F.min_by("lines", F.struct("all", "group")).alias("lines"))
    delays = lines.where((F.col("kind") == "crawl-delay") & F.col("under").isin("*", agent.lower())).groupBy("host").agg(F.max_by(F.col("value").try_cast("double"), "at").alias("crawl_delay"))
    found = F.transform("lines", lambda x: F.struct(x["path"].alias("path"), x["allow"].alias("allow")))
    hosts = files.select(F.lower("host").alias("host")).where("host <> ''").distinct()
    none = F.array().cast("array<struct<path:string,allow:boolean>>")
    return hosts.join(chosen, "host", "left").join(delays, "host", "left").select("host", F.coalesce(found, none).alias("rules"), "crawl_delay")


def decide(urls: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` and ``crawl_delay``: the first rule whose path starts the URL's path and query decides (* stands for any);
    hosts without a file, and paths without a rule, are open. ``known``: ``rules``' result, cut."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rows = urls.withColumns({"_host": host_of(F.col(url)), "_path": F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))})
    both = join_checked(rows, known.select(F.col("host").alias("_host"), F.col("rules").alias("_rules"), "crawl_delay"), ["_host"], "left")
    first = F.get(F.filter("_rules", lambda r: (r["path"] == "*") | F.startswith(F.col("_path"), r["path"])), F.lit(0))
    return both.select(*urls.columns, F.coalesce(first["allow"], F.lit(True)).alias("allowed"), "crawl_delay")


def delays(known: DataFrame, default: float) -> DataFrame:
    """(host, delay): the seconds to wait at each host that has a file."""
    return known.select("host", F.coalesce("crawl_delay", F.lit(default)).alias("delay"))
