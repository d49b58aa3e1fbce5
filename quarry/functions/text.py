"""Text functions: tokens, cleaned text, fingerprints, snippets. Column expressions; Python only where no native form exists."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import portions

# Stop words of the tokenizer, words that fingerprints drop, characters that fingerprints strip.
STOP_WORDS = tuple("a an and are as at be but by for from has have he her his i in is it its of on or she that the they this to was were will with you your".split())
FINGERPRINT_WORDS = ("the", "a", "an", "and", "or", "of", "to", "is", "in")
FINGERPRINT_STRIP = ".,;:!?\"'()[]{}"

WORD = r"[\p{L}\p{N}_]+"
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: White space as Python's str.split() sees it.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"
#: Texts that NFKC or entity decoding may change; all others are left alone without a look in Python. One greedy run over a class whose
#: first test is the ASCII range takes a fifteenth of the time of a search for an alternation of what is outside.
_REFERENCE = r"&[#A-Za-z]"
_KEPT = r"^[\x00-\x9F[¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž]]*\z"


@dataclass(frozen=True)
class Tokenizer:
    """Words of letters, digits and underscores, lower-cased after matching, without stop words, by length."""

    lowercase: bool = True
    stop_words: tuple[str, ...] | None = STOP_WORDS
    min_length: int = 2
    max_length: int = 40

    def keep(self, term: Column) -> Column:
        ok = F.length(term).between(self.min_length, self.max_length)
        return ok & ~term.isin(*self.stop_words) if self.stop_words else ok

    def raw(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
        return F.transform(words, F.lower) if self.lowercase else words

    def tokens(self, text: Column | str) -> Column:
        """Terms of a (clean) text, in order, as an array."""
        return F.filter(self.raw(F.col(text) if isinstance(text, str) else text), self.keep)

    def python(self, text: str | None) -> list[str]:
        """The same terms for a query string on the driver, cleaned first."""
        out = []
        for m in re.finditer(r"\w+", basic_clean(text)):
            term = m.group().lower() if self.lowercase else m.group()
            if self.min_length <= len(term) <= self.max_length and not (self.stop_words and term in self.stop_words):
                out.append(term)
        return out

    def stream(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """(key, term, position): kept tokens with the character offset of their first character. Offsets are a running
        sum over the alternating word and non-word pieces of a text."""
        from pyspark.sql import Window as W

        pieces = docs.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({PIECE})"), F.lit(1))).alias("_i", "_p"))
        before = W.partitionBy(key).orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
        placed = pieces.withColumn("position", F.coalesce(F.sum(F.length("_p")).over(before), F.lit(0)).cast("int"))
        term = F.lower("_p") if self.lowercase else F.col("_p")
        return placed.where(F.col("_p").rlike(f"^{WORD}$")).select(key, term.alias("term"), "position").where(self.keep(F.col("term")))


def basic_clean(text: str | None) -> str:
    """NFKC, then character references."""
    return html.unescape(unicodedata.normalize("NFKC", text)) if text else ""


def may_change(text: Column) -> Column:
    return (F.contains(text, F.lit("&")) & text.rlike(_REFERENCE)) | ~text.rlike(_KEPT)


def clean(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the columns cleaned. Rows that cannot change stay in the JVM; only the rest visit Python."""
    touched = None
    for c in columns:
        hit = F.coalesce(may_change(F.col(c)), F.lit(False))
        touched = hit if touched is None else touched | hit
    if touched is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in portions(b, list(columns)):
                new = {c: pa.array([t if t is None else basic_clean(t) for t in x.column(c).to_pylist()], x.schema.field(c).type) for c in columns}
                yield pa.RecordBatch.from_arrays([new.get(c, x.column(c)) for c in x.schema.names], schema=x.schema)

    return docs.where(~touched).unionByName(docs.where(touched).mapInArrow(run, docs.schema))


def fingerprint(text: Column) -> Column:
    """Lower-cased words without the commonest, stripped of punctuation, joined by one space."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: (w != "") & ~w.isin(*FINGERPRINT_WORDS))
    return F.array_join(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(FINGERPRINT_STRIP))), lambda w: w != ""), " ")


def content_hash(text: Column) -> Column:
    return F.sha2(fingerprint(text), 256)


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_hit(text: Column, terms: Iterable[str]) -> Column:
    """Offset of the earliest case-insensitive occurrence of any term, null if there is none."""
    low = F.lower(text)
    hits = [F.when(F.locate(t.lower(), low) > 0, F.locate(t.lower(), low) - 1) for t in terms if t]
    return (F.least(*hits) if len(hits) > 1 else hits[0]) if hits else F.lit(None).cast("int")


def snippet(text: Column, terms: Iterable[str], max_length: int = 240, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """struct(text, highlighted): a window of ``max_length`` around the earliest hit, with dots where it is cut; without a hit the whole text.
    Highlights take the leftmost hit, and of several there the first term in alphabetical order; the text keeps its case."""
    terms = sorted({t.lower() for t in terms if t})
    text = F.coalesce(text, F.lit(""))
    size, hit = F.length(text), first_hit(text, terms)
    start = F.greatest(F.lit(0), hit - max_length // 2)
    end = F.when(hit.isNull(), size).otherwise(F.least(size, start + max_length))
    start = F.when(hit.isNull(), 0).otherwise(F.greatest(F.lit(0), end - max_length))
    window = F.substring(text, start + 1, end - start)
    head, tail = F.when(start > 0, "...").otherwise(""), F.when(end < size, "...").otherwise("")
    marked = window
    if terms:
        either = "|".join(re.escape(t) for t in terms)
        marked = F.regexp_replace(window, F.lit(f"(?iu)({either})"), F.lit(f"{opening}$1{closing}"))
    return F.struct(F.concat(head, window, tail).alias("text"), F.concat(head, marked, tail).alias("highlighted"))


def snippet_html(highlighted: Column) -> Column:
    return F.concat(F.lit('<span class="snippet">'), highlighted, F.lit("</span>"))


def positions_of(text: Column, term: str) -> Column:
    """Offsets of the non-overlapping case-insensitive occurrences of a term: running lengths of what lies between them."""
    parts = F.split(F.lower(text), re.escape(term.lower()), -1)
    n = len(term)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), term.lower())).cast("int")) if n else F.array().cast("array<int>")


def uses(terms: list[str]) -> list[str]:
    """Distinct terms in order of the alphabet, as scoring uses them."""
    return sorted(set(terms))
