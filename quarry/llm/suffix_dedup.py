"""Removal of byte strings that occur more than once, by column-wise construction of a collection's suffix order.

The corpus falls into segments of equal anchors (see ``anchors``): every window of ``length`` bytes lies in one segment, equal windows
under one key. A shard orders the suffixes of its segments column by column: each round inserts one more symbol of every
segment, from the last to the first, into the Burrows-Wheeler transform of the collection, and updates the common prefixes of
neighbouring rows next to the insertions. The columns of symbols are an external file, written once and read in sequence, a column a
round; the transform of a collection is bounded and is merged with a round's insertions in one pass. Symbols are blocks of eight bytes counted from the anchor, so equal windows have equal blocks; rows whose common prefix
has the blocks that a window surely contains form a class, and the bytes of the window before and after those blocks decide.

Defined results: null text is empty; matches never cross documents; a repeated row counts as another place; texts shorter than a window
keep everything; removal is judged on the input; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import anchors
from quarry.llm.anchors import Group, Reader, Spans

BLOCK = 8


class Columns:
    """The symbols of all strings, a column a round, in one external file that is written and read in sequence. A column has the j-th
    symbol from the end of each string that has one, strings in order of their numbers."""

    def __init__(self, strings: list[np.ndarray], folder: str):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.strings, self.rounds = len(strings), int(sizes.max(initial=0))
        self.path = os.path.join(folder, "columns")
        by_size = np.argsort(-sizes, kind="stable")
        flat, ends = np.concatenate([*strings, np.zeros(0, np.int32)]).astype(np.int32), np.cumsum(sizes)
        self.counts = np.searchsorted(-sizes[by_size], -np.arange(self.rounds), side="left")
        with open(self.path, "wb", buffering=1 << 20) as f:
            for j, n in enumerate(self.counts):
                longer = np.sort(by_size[:n])
                f.write(longer.astype(np.int32).tobytes())
                f.write(flat[ends[longer] - 1 - j].tobytes())

    def __iter__(self) -> Iterator[np.ndarray]:
        """For each round the symbols by string, -1 where the string has ended."""
        with open(self.path, "rb", buffering=1 << 20) as f:
            for n in self.counts.tolist():
                column = np.full(self.strings, -1, np.int64)
                who = np.frombuffer(f.read(4 * n), np.int32)
                column[who] = np.frombuffer(f.read(4 * n), np.int32)
                yield column


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both included, for many ranges at once."""
    out = np.empty(len(lo), values.dtype)
    power = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    level = values
    for j in range(int(power.max()) + 1 if len(power) else 0):
        mine = np.flatnonzero(power == j)
        if len(mine):
            out[mine] = np.minimum(level[lo[mine]], level[hi[mine] - (1 << j) + 1])
        if len(level) > 1 << j:
            level = np.minimum(level[: len(level) - (1 << j)], level[1 << j :])
    return out


def suffix_order(strings: list[np.ndarray], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, lcp) of all suffixes of the strings in their order, empty ones first; strings end in terminators of
    their own, smaller than any symbol. ``lcp``: symbols shared with the row above.

    A round's insertions are sorted among themselves and merged into what is there in one pass. What is held between rounds is a
    collection's transform, which is bounded; the strings themselves are read from the external columns, one a round."""
    m = len(strings)
    columns = iter(Columns(strings, folder))
    symbol = next(columns, np.full(m, -1, np.int64))  # what stands before each row's suffix: the transform
    lcp, sid, size = np.zeros(m, np.int16), np.arange(m, dtype=np.int32), np.zeros(m, np.int16)
    merged, fresh = np.zeros(0, np.int64), np.arange(m)  # (first symbol, row of the rest) of each row but the empty suffixes; rows of the last round
    j = 0
    while len(act := fresh[symbol[fresh] >= 0]):
        new = (symbol[act] << 32) | act  # rows by (symbol before, row): their order is the order of the longer suffixes
        order = np.argsort(new)
        new, act = new[order], act[order]
        at = np.searchsorted(merged, new)
        both = np.insert(merged, at, new)
        place = at + np.arange(len(new))
        is_new = np.zeros(len(both), bool)
        is_new[place] = True
        source, first = both & 0xFFFFFFFF, both >> 32
        # common prefixes: one more than the least between the two sources, if the first symbols are equal
        after = np.zeros(len(both), bool)
        after[1:] = is_new[:-1]
        shared = np.zeros(len(both), np.int16)
        shared[~is_new] = lcp[m:]
        shared[after & ~is_new] = 0
        changed = np.flatnonzero(is_new | after)
        changed = changed[changed > 0]
        changed = changed[first[changed] == first[changed - 1]]
        if len(changed):
            shared[changed] = 1 + _range_min(lcp, source[changed - 1] + 1, source[changed])
        j += 1
        column = next(columns, None)
        before = np.full(len(act), -1, np.int64) if column is None else column[sid[act]]  # what stands before the new suffixes
        count = np.cumsum(np.bincount(at, minlength=len(merged) + 1))
        moved = source + np.where(source >= m, count[np.maximum(source - m, 0)], 0)
        own = sid[act]
        symbol = np.concatenate((symbol[:m], np.insert(symbol[m:], at, before)))
        lcp = np.concatenate((lcp[:m], shared))
        sid = np.concatenate((sid[:m], np.insert(sid[m:], at, own)))
        size = np.concatenate((size[:m], np.insert(size[m:], at, np.full(len(own), j, np.int16))))
        merged, fresh = (first << 32) | moved, place + m
    return sid, size, lcp


def repeated_windows(contents: list[bytes], offsets: list[int], times: np.ndarray, length: int, folder: str) -> list[np.ndarray]:
    """For each content the flags of its windows that occur twice or more in the collection, contents counting ``times`` times."""
    whole = (length - BLOCK + 1) // BLOCK  # blocks that every window contains
    lead = [a % BLOCK for a in offsets]
    data = np.frombuffer(b"".join(contents) + bytes(2 * BLOCK), np.uint8)
    base = np.cumsum([0] + [len(c) for c in contents])
    blocks = [np.frombuffer(c, ">u8", count=(len(c) - h) // BLOCK, offset=h) for c, h in zip(contents, lead)]
    ranks = np.unique(np.concatenate(blocks), return_inverse=True)[1].astype(np.int32)
    cuts = np.cumsum([len(b) for b in blocks])[:-1]
    sid, size, lcp = suffix_order(np.split(ranks, cuts), folder)
    enough = size >= whole
    cls = np.cumsum(lcp < whole)[enough]
    sid, size = sid[enough].astype(np.int64), size[enough].astype(np.int64)
    weight = np.bincount(cls, times[sid], minlength=int(cls[-1]) + 1 if len(cls) else 1)
    several = weight[cls] >= 2
    cls, sid, size = cls[several], sid[several], size[several]
    n_blocks, lead = np.array([len(b) for b in blocks]), np.array(lead)
    lens = base[1:] - base[:-1]
    flags = np.zeros(base[-1] + 1, bool)  # by window start in the joined contents
    inside = lead[sid] + BLOCK * (n_blocks[sid] - size)  # where the row's first block starts
    for a in range(BLOCK):  # bytes of the window before its first whole block
        tail = length - BLOCK * whole - a
        ok = (inside >= a) & (inside + BLOCK * whole + tail <= lens[sid])
        c, s, at = cls[ok], sid[ok], inside[ok]
        if not len(c):
            continue
        where = base[s] + at
        rest = np.empty((len(c), a + tail), np.uint8)
        for k in range(a):
            rest[:, k] = data[where - a + k]
        for k in range(tail):
            rest[:, a + k] = data[where + BLOCK * whole + k]
        order = np.lexsort((*rest.T[::-1], c))
        new = np.concatenate(([True], (c[order][1:] != c[order][:-1]) | (rest[order][1:] != rest[order][:-1]).any(axis=1)))
        kind = np.cumsum(new) - 1
        twice = np.bincount(kind, times[s[order]])[kind] >= 2
        flags[(where - a)[order][twice]] = True
    return [flags[base[i] : base[i] + max(0, len(c) - length + 1)] for i, c in enumerate(contents)]


def _judge(length: int):
    def judge(collection: list[Group]) -> Iterator[Spans]:
        open_groups = [g for g in collection if len(g.contents) > 1]
        contents = [c for g in open_groups for c in g.contents]
        times = np.array([sum(len(m[0]) for m in ms) for g in open_groups for ms in g.members])
        found: dict[int, np.ndarray] = {}
        if contents:
            with tempfile.TemporaryDirectory(prefix="columns-") as folder:
                flags = repeated_windows(contents, [a for g in open_groups for a in g.anchors], times, length, folder)
            found = dict(enumerate(flags))
        at = 0
        for g in collection:
            for content, members in zip(g.contents, g.members):
                who = anchors.joined_members(members)
                n = len(who[0])
                at += len(g.contents) > 1
                if n > 1:
                    yield anchors.expanded(who, np.arange(n), np.array([[0, len(content)]]))
                elif len(g.contents) > 1:
                    spans = anchors.window_spans(found[at - 1], length)
                    if len(spans):
                        yield anchors.expanded(who, np.arange(1), spans)

    return judge


def _codes(text: str) -> tuple[np.ndarray, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8), raw


def reader(length: int) -> Reader:
    return Reader(_codes, lambda raw, a, b: raw[a:b], length, max(1, min(16, length // 4)))


def repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, rid, text, spans): ``spans`` has the (doc_id, start, end) byte ranges to remove, null for none."""
    if length < 2 * BLOCK:
        raise ValueError(f"length must be at least {2 * BLOCK}")
    return anchors.with_spans(anchors.with_row_ids(docs), reader(length), _judge(length))


def deduplicated(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is what remains, as bytes (a cut may fall inside a character)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, s in zip(b.column(1), anchors.spans_of(b.column(2), b.column(0))):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                kept = b"".join(raw[a:e] for a, e in zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), len(raw)]))
                for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(s), kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeated(docs, length).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(removed, spans, kept) by the definition, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


