"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, ``root`` the least node of its component. Each round takes the least neighbour of
    each node by a pre-aggregated group-by and joins it back, so no node's neighbours meet in one place as a list; rounds end
    when nothing moves (logarithmically many)."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
        state = tuple(now)
        # large star: every neighbour above a node goes to the least of its neighbourhood
        both = e.unionAll(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", "m")).where("u <> v").distinct())
