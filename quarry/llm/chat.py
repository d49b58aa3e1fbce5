"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes one or more training windows of at most ``budget`` tokens. Prefix sums of turn tokens place each turn
on a ruler with strides of ``budget - history`` (less the system turn): turns that lie inside one stride form a window, a turn
that crosses a stride's end is a window of its own, so every window is a turn-aligned span and needs no look at other
windows. Each window starts with the conversation's system turn, then repeats the last turns before its span that fit
into ``history`` tokens. The loss mask covers the assistant turns of the span itself: repeated ones are masked out, so every
assistant text is a target exactly once. Nothing is cut: a turn longer than a stride stands whole in its own window, and a system turn of
more than half a stride still leaves the others half of one; these are the cases that exceed the budget, the second by no more than the system turn.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Control strings inside roles and texts (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) get a backslash after their first character; one that already has
backslashes there gets one more. Taking one away restores the text exactly.

Defined results: null role and null text are empty; null conv_id is a conversation of its own; null turns come first, equal turns go
by role and text; repeated rows are repeated turns; further columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TAIL = r"(\||/?s>|/?INST\]|</?SYS>>)"
#: Tokens of a text as the budget counts them (runs of letters or digits, single other characters), and of a turn's markers.
TOKEN, MARKERS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]", 4
#: Turn numbers of a block of the two-level prefix sums.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])(\\*)" + _TAIL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])\\(\\*)" + _TAIL), F.lit("$1$2$3"))


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, role, body, tokens, start): turns in order with the tokens before them; sums inside blocks of turn
    numbers, then over blocks, so that a long conversation is not one task's."""
    t = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        escape(F.coalesce("role", F.lit(""))).alias("head"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("target"),
        (F.coalesce("role", F.lit("")) == "system").alias("system"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long").alias("block"),
    ).withColumn("tokens", (F.regexp_count("body", F.lit(TOKEN)) + MARKERS).cast("long"))
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "head", "body")
    t = t.withColumns({"seq": F.row_number().over(inside).cast("long"), "upto": F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0))})
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    along = W.partitionBy("conv_id").orderBy("block")
    offsets = blocks.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), (F.sum("n").over(along) - F.col("n")).alias("seq0"), (F.sum("sum").over(along) - F.col("sum")).alias("before")
    )
    joined = t.join(offsets, t.conv_id.eqNullSafe(offsets["_c"]) & (t.block == offsets["_b"]))
    return joined.select("conv_id", (F.col("seq0") + F.col("seq") - 1).alias("seq"), "head", "body", "target", "system", "tokens", (F.col("before") + F.col("upto") - F.col("tokens")).alias("start"))


def windows(conversations: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """(conv_id, window, formatted, tokens, n_turns, n_repeated, loss): ``loss`` holds (start, length) in code points of
    ``formatted``; the first ``n_repeated`` turns stand in an earlier window too."""
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and less than budget")
    t = _numbered(conversations)
    system = t.where("seq = 0 AND system").select(F.col("conv_id").alias("_c"), F.col("tokens").alias("system_tokens"), F.struct("head", "body", "tokens").alias("system_turn"))
    joined = t.join(system, t.conv_id.eqNullSafe(F.col("_c")), "left").drop("_c")
    stride = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit((budget - history) // 2), F.lit(1))
    placed = joined.withColumn("stride", stride).withColumn("first", F.col("start") - F.coalesce("system_tokens", F.lit(0)))
    is_system = F.col("system_tokens").isNotNull() & (F.col("seq") == 0)
    placed = placed.withColumn("first", F.when(is_system, 0).otherwise(F.col("first"))).withColumn("bin", F.when(is_system, 0).otherwise(F.floor(F.col("first") / F.col("stride"))))
    crosses = ~is_system & (F.floor((F.col("first") + F.col("tokens") - 1) / F.col("stride")) > F.col("bin"))
    placed = placed.withColumn("window", 2 * F.col("bin") + crosses.cast("long")).withColumn("is_system", is_system)
    placed = cut(placed)  # read five times below
    # where each window's span begins; the first window holds the system turn itself
    spans = placed.groupBy("conv_id", "window").agg(
        F.min(F.when(~F.col("is_system"), F.col("first"))).alias("begins"), F.max(F.col("is_system")).alias("has_system"), F.min("bin").alias("bin"), F.min("stride").alias("stride"), F.first("system_turn").alias("system_turn")
    )
    own = placed.select("conv_id", "window", F.lit(2).alias("part"), "seq", "head", "body", "target", "tokens")
    # a turn is history of windows that begin less than `history` (and a stride) after its start: in its own bin or the next
    h = placed.where(~F.col("is_system")).select(F.col("conv_id").alias("_c"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("_bin"), F.col("first").alias("_first"), F.col("tokens"), "seq", "head", "body")
    reach = F.least(F.lit(history), F.col("stride"))
    again = spans.join(h, spans.conv_id.eqNullSafe(F.col("_c")) & (spans.bin == F.col("_bin"))).where((F.col("_first") + F.col("tokens") <= F.col("begins")) & (F.col("begins") - F.col("_first") <= reach))
    again = again.select("conv_id", "window", F.lit(1).alias("part"), "seq", "head", "body", F.lit(False).alias("target"), "tokens")
    kept = spans.where("system_turn IS NOT NULL AND NOT has_system").select("conv_id", "window", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), "system_turn.head", "system_turn.body", F.lit(False).alias("target"), "system_turn.tokens")
    rows = own.unionByName(again).unionByName(kept)
    rows = rows.withColumn("lead", F.concat(F.lit(TURN), "head", F.lit(TEXT))).withColumn("piece", F.concat("lead", "body", F.lit(END)))
    before = W.partitionBy("conv_id", "window").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("lead"))
    turn = F.struct("part", "seq", "piece", F.when(F.col("target"), F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length"))).alias("loss"))
    made = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("tokens").alias("tokens"))
    return made.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        "tokens",
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda x: x["part"] < 2)).alias("n_repeated"),
        F.filter(F.transform("turns", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``windows``' rows with what their text says: ``turns``, an array of (role, text) without the repeated turns, and
    ``targets``, the texts under the loss mask."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), F.col("n_repeated") + 2, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))

    def parsed(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(F.substring(x, F.length(role) + len(TEXT) + 1, F.length(x)), END, 1)).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, parsed)).withColumn("targets", F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))))
