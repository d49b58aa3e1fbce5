"""Removal of word windows that start in an earlier document, by compressed FM-indexes.

The corpus falls into segments of equal anchors (see ``anchors``), and a shard has all segments of its keys. Over a collection of
them it builds an FM-index: a Burrows-Wheeler transform over words, held as a wavelet tree of packed bit vectors with sampled ranks
(levels stored one after the other, as a wavelet matrix), and beside it, in suffix order, the number of the document that each suffix
comes from. The segments are then streamed against the index: backward search extends all their windows by one word a step,
narrowing the suffix interval; what reaches the threshold is reported with its interval, and the least document of the interval tells
whether the window also starts in an earlier one.

Suffixes are ordered by their first ``length`` words at least, which is all that patterns of that length need.

Defined results: null text has no words; a window in the same document or in rows of the same doc_id does not count, nor does a
document without doc_id count as earlier or later than any; texts shorter than a window keep everything; windows are judged on the
input; repeated rows have equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import anchors
from quarry.llm.anchors import Group, Reader, Spans

_NONE = -(2**63)  # how ``anchors`` writes a null doc_id


class WaveletMatrix:
    """Ranks over a sequence of numbers in [0, 2^levels): one packed bit vector a level, with a rank sample every 64 bits."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.zeros, self.bits, self.samples = levels, [], [], []
        v = values.astype(np.int64)
        pad = -len(v) % 64 + 64
        for level in range(levels - 1, -1, -1):
            bit = ((v >> level) & 1).astype(bool)
            words = np.packbits(np.concatenate((bit, np.zeros(pad, bool))), bitorder="little").view("<u8")
            self.bits.append(words)
            self.samples.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate((v[~bit], v[bit]))

    def rank_pair(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol occurs before lo and before hi, less the same constant for each symbol: both are positions in the
        sequence sorted by symbol, so their difference is the count between."""
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            lo_ones, hi_ones = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, lo_ones + self.zeros[k], lo - lo_ones)
            hi = np.where(one, hi_ones + self.zeros[k], hi - hi_ones)
        return lo, hi

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.samples[k][word] + np.bitwise_count(below)


class FMIndex:
    """Over integer sequences; 0 ends each. ``depth``: how many symbols the suffix order looks at."""

    def __init__(self, sequences: np.ndarray, depth: int):
        n = len(sequences)
        rank = sequences.astype(np.int64)
        reach = 1
        while reach < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - reach] = rank[reach:] + 1
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        top = int(sequences.max(initial=0))
        self.levels = max(1, top.bit_length())
        self.before = WaveletMatrix(sequences[self.order - 1], self.levels)
        # where each symbol starts: in the suffix order, and in the matrix's own order (symbols by reversed bits)
        counts = np.bincount(sequences, minlength=top + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        reversed_bits = np.zeros(top + 1, np.int64)
        for b in range(self.levels):
            reversed_bits |= ((np.arange(top + 1) >> b) & 1) << (self.levels - 1 - b)
        by_bits = np.argsort(reversed_bits)
        self.inner = np.empty(top + 1, np.int64)
        self.inner[by_bits] = np.concatenate(([0], np.cumsum(counts[by_bits])[:-1]))
        self.n = n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from the intervals of the patterns."""
        a, b = self.before.rank_pair(symbol, lo, hi)
        shift = self.first[symbol] - self.inner[symbol]
        return a + shift, b + shift


def _range_min_table(values: np.ndarray) -> list[np.ndarray]:
    table = [values]
    while len(table[-1]) > 1 << (len(table) - 1):
        j = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][: len(table[-1]) - j], table[-1][j:]))
    return table


def least_documents(contents: list[bytes], documents: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each content the least of ``documents`` among the contents that have it."""
    words: dict[bytes, int] = {}
    ids = [np.array([words.setdefault(w, len(words) + 1) for w in c.split()], np.int64) for c in contents]
    sizes = np.array([len(x) for x in ids])
    # number words in the order of their first use; 0 ends a segment
    text = np.zeros(int(sizes.sum()) + len(ids), np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    for s, x in zip(starts, ids):
        text[s : s + len(x)] = x
    index = FMIndex(text, length)
    by_value = np.unique(documents)
    source = np.repeat(np.searchsorted(by_value, documents).astype(np.int32), sizes + 1)
    table = _range_min_table(source[index.order])
    windows = np.concatenate([s + np.arange(max(0, n - length + 1)) for s, n in zip(starts, sizes)]).astype(np.int64)
    lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), index.n, np.int64)
    for step in range(length - 1, -1, -1):  # a window is in the index itself, so no interval gets empty
        lo, hi = index.extend(text[windows + step], lo, hi)
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    least = np.empty(len(windows), np.int32)
    for j in range(int(power.max(initial=0)) + 1):
        mine = np.flatnonzero(power == j)
        least[mine] = np.minimum(table[j][lo[mine]], table[j][hi[mine] - (1 << j)])
    return np.split(by_value[least], np.cumsum(np.maximum(0, sizes - length + 1))[:-1])


def _judge(length: int):
    def judge(collection: list[Group]) -> Iterator[Spans]:
        last = np.iinfo(np.int64).max
        several: list[tuple[bytes, list[np.ndarray]]] = []
        firsts: list[int] = []
        for g in collection:
            whos = [anchors.joined_members(ms) for ms in g.members]
            lows = [int(np.where(w[0] == _NONE, last, w[0]).min()) for w in whos]
            low = min(lows)
            if all(int(w[0].max()) <= low for w in whos):
                continue  # nobody comes later
            if len(whos) == 1:
                yield anchors.expanded(whos[0], np.flatnonzero(whos[0][0] > low), np.array([[0, len(g.contents[0].split())]]))
            else:
                several += zip(g.contents, whos)
                firsts += lows
        if not several:
            return
        found = least_documents([c for c, _ in several], np.array(firsts, np.int64), length)
        for (_, who), least in zip(several, found):
            docs = who[0]
            for d in np.unique(docs[docs > int(least.min())]).tolist():
                spans = anchors.window_spans(least < d, length)
                yield anchors.expanded(who, np.flatnonzero(docs == d), spans)

    return judge


def _codes(text: str) -> tuple[np.ndarray, tuple[bytes, np.ndarray, np.ndarray]]:
    raw = text.encode("utf-8", "surrogatepass")
    codes, starts, ends = anchors.words_of(raw)
    return codes, (raw, starts, ends)


def _content(view: tuple[bytes, np.ndarray, np.ndarray], a: int, b: int) -> bytes:
    raw, starts, ends = view
    return raw[starts[a] : ends[b - 1]]


def reader(length: int) -> Reader:
    return Reader(_codes, _content, length, max(1, min(5, length // 2)))


def repeated(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, rid, text, spans): ``spans`` has the (doc_id, start, end) word ranges to remove, null for none."""
    return anchors.with_spans(anchors.with_row_ids(docs), reader(length), _judge(length))


def deduplicated(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` has the remaining words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], []]
            for text, s in zip(b.column(1), anchors.spans_of(b.column(2), b.column(0))):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                kept = [w for a, e in zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), len(words)]) for w in words[a:e]] if len(s) else words
                for c, v in zip(cols, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return repeated(docs, length).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cleaned(docs: DataFrame, length: int = 13) -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text``: where nothing goes the text stays as it is, else the remaining words
    are joined by one space; ``n_chars``, if there is one, follows."""
    names = [c for c in docs.columns if c != "text"]
    spans = repeated(docs, length).where("spans IS NOT NULL").select(F.col("rid").alias("_rid"), F.col("doc_id").alias("_doc"), F.col("spans").alias("_spans")).dropDuplicates(["_rid", "_doc"])
    mine = docs.withColumns({"_rid": anchors.row_id(), "_doc": F.col("doc_id").cast("long")})
    spans = spans.withColumnsRenamed({"_rid": "_r", "_doc": "_d"})
    joined = mine.join(spans, (F.col("_rid") == F.col("_r")) & F.col("_doc").eqNullSafe(F.col("_d")), "left").select(*names, "text", "_spans", "_doc")
    schema = type(docs.schema)([*docs.select(*names).schema.fields]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, s in zip(b.column(len(names)), anchors.spans_of(b.column(len(names) + 1), b.column(len(names) + 2))):
                t = text.as_py()
                if len(s):
                    words = t.encode("utf-8", "surrogatepass").split()
                    t = b" ".join(w for a, e in zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), len(words)]) for w in words[a:e]).decode("utf-8", "surrogatepass")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])

    out = joined.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]], length: int) -> list[tuple[int, int, str]]:
    """(words, removed, kept) by the definition, for tests."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            if d is not None:
                first[tuple(w[i : i + length])] = min(d, first.get(tuple(w[i : i + length]), d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out
