"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions.

Each source queues its documents in a shuffled order that depends on doc_id alone, up to ``max_epochs`` times over. A
document's virtual finish time is the source's cumulative tokens, itself included, divided by the source's target. In the order
of finish times every source has had the same share of its target at any moment; the mix is that order, cut where the
total budget is reached.

Prefix sums are made in two levels, over hash ranges of a source and then inside a range, and the cut is found by
histograms over finish times, so that no task gets a whole source and nothing but 4097 sums a level reaches the driver.

Defined results: null text has size 0; documents of size 0 are never taken; null source is a source of its own, last in
order; targets are capped at ``max_epochs`` times a source's size and the excess is shared again by weight; ties in the order
go by source, shuffle key, doc_id and epoch; equal rows are taken alike; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import cut, join_checked

#: Words, as sizes count them.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges of a source, and steps of finish time in a level of the search for the cut.
RANGES, STEPS = 4096, 4096
#: A level of the search ends in a sort when so few rows are left.
SORT_ROWS = 50_000


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, key): the words of each text and the place of the document in its source's shuffled queue; and
    the columns of ``carry``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
        *carry,
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, rank, source_size, target) for each source: weights repeat over sources in code point order, null last; what
    exceeds ``max_epochs`` times a source's size is shared again by weight (water level over sources in order of cap / weight)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    filled = W.orderBy((max_epochs * F.col("source_size") / F.col("weight")), "rank")
    everything = W.partitionBy()
    level = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "capped": F.sum(max_epochs * F.col("source_size")).over(filled) - max_epochs * F.col("source_size"),
        "open": F.sum("weight").over(everything) - F.sum("weight").over(filled) + F.col("weight"),
    }).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    full = level.withColumn("full", max_epochs * F.col("source_size") <= F.col("level") * F.col("weight"))
    water = F.min(F.when(~F.col("full"), F.struct(max_epochs * F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double")).otherwise(water * F.col("weight"))
    return full.select("source", "rank", "source_size", target.cast("double").alias("target"))


def queued(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with rank, source_size, target and ``upto``: the tokens of the source's queue up to and with the document."""
    named = join_checked(rows.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))), cut(targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("_s"), "rank", "source_size", "target")), ["_s"]).drop("_s")
    named = named.withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sums = named.groupBy("rank", "range").agg(F.sum("size").alias("n"))
    offsets = sums.select("rank", "range", (F.sum("n").over(W.partitionBy("rank").orderBy("range")) - F.col("n")).alias("before"))
    inside = W.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    return named.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["rank", "range"]).withColumn("upto", F.col("before") + F.col("inside")).drop("inside", "before", "range")


def finish(epoch: Column) -> Column:
    """Virtual finish time in the given epoch (0, 1, ...)."""
    return F.try_divide((epoch * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def find_cut(queue: DataFrame, budget: int, max_epochs: int = 3) -> tuple | None:
    """The last (finish, rank, key, doc_id, epoch) whose cumulative size in the global order stays within ``budget``."""
    rows = queue.where("size > 0 AND target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("finish", finish(F.col("epoch")))
    low, high, before = 0.0, 2.0, 0  # finish times lie around 1; what lies above a level's end is its last step
    while True:
        step = F.least(F.floor((F.col("finish") - low) * (STEPS / (high - low))), F.lit(STEPS)).cast("int")
        sums = sorted(rows.groupBy(step.alias("step")).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect())  # STEPS + 1 rows at most
        inside = None
        for s in sums:
            if before + s["n"] > budget:
                inside = s
                break
            before += s["n"]
        if inside is None:  # everything fits
            inside = sums[-1] if sums else None
            if inside is None:
                return None
            before -= inside["n"]
        rows = rows.where(step == inside["step"])
        width = (high - low) / STEPS
        if inside["rows"] <= SORT_ROWS or width < 1e-13 or inside["step"] == STEPS:
            break
        low, high = low + inside["step"] * width, low + (inside["step"] + 1) * width
    order = ["finish", "rank", "key", "doc_id", "epoch"]
    running = F.sum("size").over(W.orderBy(*order, "size").rowsBetween(W.unboundedPreceding, 0))
    last = rows.withColumn("running", running).where(F.col("running") <= budget - before).orderBy(*[F.desc(c) for c in order]).select(*order).first()
    return tuple(last) if last is not None else (low + inside["step"] * ((high - low) / STEPS) if inside["step"] else 0.0, 0, "", None, -1)


def taken_epochs(last: tuple | None, max_epochs: int = 3) -> Column:
    """How often the mix that ends with ``last`` takes the document: 0 to ``max_epochs``."""
    if last is None:
        return F.lit(0)
    at, rank, key, doc_id, epoch = last
    out = F.lit(0)
    for e in range(max_epochs):
        f = finish(F.lit(e))
        same = F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("long"))
        less_id = F.coalesce(F.col("doc_id") < F.lit(doc_id).cast("long"), F.col("doc_id").isNull() & F.lit(doc_id is not None))
        tie = (F.col("rank") < rank) | ((F.col("rank") == rank) & ((F.col("key") < key) | ((F.col("key") == key) & (less_id | (same & F.lit(e <= epoch))))))
        out = out + F.when((F.col("size") > 0) & (F.col("target") > 0) & ((f < at) | ((f == at) & tie)), 1).otherwise(0)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, finish) for each document; ``epochs`` copies of it are in the mix.
    ``budget``: total tokens, by default all there are."""
    rows = cut(sized(docs, carry))
    queue = cut(queued(rows, source_targets(rows, weights, max_epochs)))
    total = queue.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] if budget is None else budget
    last = find_cut(queue, total, max_epochs)
    return queue.select("doc_id", "source", "size", "source_size", "target", taken_epochs(last, max_epochs).alias("epochs"), finish(F.lit(0)).alias("finish"), "key", "rank", "upto", *carry)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None) -> DataFrame:
    """The mix itself: a row for each copy taken, range-sorted by virtual finish time."""
    out = mix(docs, weights, max_epochs, budget).where("epochs > 0").withColumn("epoch", F.explode(F.expr("sequence(0, epochs - 1)")))
    return out.withColumn("finish", finish(F.col("epoch"))).orderBy("finish", "rank", "key", "doc_id", "epoch").select("doc_id", "source", "size", "epoch", "finish")


def repeated_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row stands in the result as often as its document is taken."""
    rid = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source", "text")))
    keyed = docs.withColumn("_rid", rid)
    taken = cut(mix(keyed, weights, max_epochs, budget, ("_rid",)).where("epochs > 0").groupBy("_rid").agg(F.max("epochs").alias("_epochs")))
    return join_checked(keyed, taken, ["_rid"]).withColumn("_epoch", F.explode(F.expr("sequence(1, _epochs)"))).select(*docs.columns)
