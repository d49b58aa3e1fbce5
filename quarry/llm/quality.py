"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule reads a feature or two of a text. On a bounded sample the cascade measures what each rule costs (seconds to evaluate its
features, net of what any job costs) and how many texts it rejects, orders the rules by rejections per cost, and evaluates them as one
CASE: a text that an early rule rejects never pays for the later features. Features that a caller needs as columns anyway are given to
the cascade and cost a rule nothing. The order changes the speed, never the verdict.

The sample is taken by a hash of doc_id and text over all partitions, whole texts of any length, about ``SAMPLE_ROWS`` of them; it stays on
the executors, and only sums reach the driver.

Defined results: null and empty texts have no words, so every count is 0 and the word-count rule rejects them; repeated rows are
judged alike; rules of equal rejections per cost keep the given order; other columns pass through ``judge`` untouched (its own column is
``kept``); an empty table gives an empty result (the sample is empty, the order then is the given one).
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

#: Rows of the sample that costs and selectivities are estimated on; they decide the order of the rules only.
SAMPLE_ROWS = 300
#: How often a timed job evaluates each row of the sample.
REPEATS = 4


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words, their 3-word windows as (hash, start) in hash order, and lines that have a word; {text} is the text column.
WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+', 0)"
LINES = "filter(split(coalesce({text}, ''), '\n', -1), x -> btrim(x, ' \t\n\x0b\x0c\r') <> '')"
WINDOWS = "sort_array(if(size({words}) < 3, array(), transform(sequence(0, size({words}) - 3), i -> struct(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) AS h, i AS at))))"
#: A window is found twice or more if a neighbour in hash order has its hash.
REPEATED = "filter({windows}, (x, i) -> coalesce(x.h = get({windows}, i - 1).h, false) OR coalesce(x.h = get({windows}, i + 1).h, false))"

FEATURES = {
    "n_words": "CAST(size({words}) AS BIGINT)",
    "word_chars": "CAST(length(translate(coalesce({text}, ''), ' \t\n\x0b\x0c\r', '')) AS BIGINT)",
    "n_symbols": "CAST(length(coalesce({text}, '')) - length(translate(coalesce({text}, ''), '#*$%&|<>', '')) AS BIGINT)",
    "n_dup_lines": "CAST(size({lines}) - size(array_distinct({lines})) AS BIGINT)",
    "n_repeat_words": "CAST(size(array_distinct(flatten(transform({repeated}, x -> array(x.at, x.at + 1, x.at + 2))))) AS BIGINT)",
    # further ones, which only the rules read
    "n_lines": "CAST(size({lines}) AS BIGINT)",
    "n_capitals": "CAST(length(coalesce({text}, '')) - length(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT)",
    "n_digits": "CAST(length(coalesce({text}, '')) - length(translate(coalesce({text}, ''), '0123456789', '')) AS BIGINT)",
    "n_different_words": "CAST(size(array_distinct({words})) AS BIGINT)",
}
#: The features that ``with_base`` gives as columns.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BOUND = {"words": "w", "lines": "ls", "windows": "ws"}


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over feature names; a text that it holds for is rejected."""

    name: str
    fails: str


#: Clean prose has hardly any of the symbols, words of 2 to 12 characters on average, few repeated lines or windows, and neither
#: capitals nor digits for most of its letters; it has more than a handful of words.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("capitals", "100 * n_capitals > 60 * word_chars"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
    Rule("few_different_words", "n_different_words < 15"),
)


def _written_out(feature: str, text: str) -> str:
    """The feature over the text alone."""
    body = FEATURES[feature].replace("{repeated}", _let("ws", WINDOWS.format(words="w"), REPEATED.format(windows="ws")))
    for part, value in (("words", WORDS), ("lines", LINES)):
        name = _BOUND[part]
        body = body.replace("{" + part + "}", name)
        if f"({name}" in body or f" {name}[" in body:
            body = _let(name, value.format(text=text), body)
    return body.replace("{text}", text)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the features of ``BASE`` as columns, each computed once, and the parts ``_words`` and ``_lines`` that further features read."""
    step = docs.withColumns({"_words": F.expr(WORDS.format(text=text)), "_lines": F.expr(LINES.format(text=text))})
    # bound by name, so that a plan that writes the columns out does not evaluate them for each element
    step = step.withColumn("_windows", F.expr(_let("w", "_words", WINDOWS.format(words="w")))).withColumn("_repeated", F.expr(_let("ws", "_windows", REPEATED.format(windows="ws"))))
    return step.withColumns({k: F.expr(FEATURES[k].format(text=text, words="_words", lines="_lines", repeated="_repeated")) for k in BASE}).drop("_windows", "_repeated")


def _inline(rule: Rule, text: str, given: tuple[str, ...] = ()) -> str:
    """The rule with the features that it names written out, so that nothing else is evaluated for it. ``given``: those that are columns;
    with any, ``_words`` and ``_lines`` are columns too."""

    def written(m: re.Match) -> str:
        if m[1] in given:
            return m[1]
        body = FEATURES[m[1]].format(text=text, words="_words", lines="_lines", repeated="_repeated") if given else _written_out(m[1], text)
        return f"({body})"

    return re.sub(r"\b(" + "|".join(FEATURES) + r")\b", written, rule.fails)


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts of all partitions, by hash; a repeated row counts once."""
    key = F.xxhash64(*[F.col(c) for c in ("doc_id", text) if c in docs.columns])
    keyed = docs.select(F.col(text).alias("text"), key.alias("_key"))
    one_in = max(1, docs.count() // rows)
    return keyed.where(F.pmod(F.xxhash64("_key"), F.lit(one_in)) == 0).dropDuplicates(["_key"]).select("text")


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample, best rejection per cost first. Features in ``given`` cost nothing."""
    sample = sampled(docs, text, sample_rows)
    sample = cut((with_base(sample) if given else sample).repartition(1))
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(fails: str) -> tuple[float, float]:
        job = many.agg(F.avg(F.expr(f"CAST(({fails}) AND _again > 0 AS INT)")))
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            share = job.first()[0]
            best = min(best, time.perf_counter() - began)
        return best, share or 0.0

    idle = timed("false")[0]
    out = [(rule, max(took - idle, 1e-4), share) for rule in rules for took, share in [timed(_inline(rule, "text", given))]]
    return sorted(out, key=lambda x: -x[2] / x[1])


def cascade(ordered: list[Rule], text: str = "text", given: tuple[str, ...] = ()) -> str:
    """SQL of the verdict: true if no rule rejects. Features are computed on the way and only as far as needed, but for the ``given`` ones,
    which are columns of ``with_base``."""
    cases = " ".join(f"WHEN {_inline(r, text, given)} THEN false" for r in ordered)
    return f"CASE {cases} ELSE true END"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``kept``: the verdict of the cascade in its measured order."""
    return docs.withColumn("kept", F.expr(cascade([r for r, _, _ in plan(docs, rules, text)], text)))
