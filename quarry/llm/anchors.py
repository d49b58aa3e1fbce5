"""Where equal windows of a corpus can lie: anchors, runs and segments, shared by the two exact-substring operators.

A window of ``length`` symbols has an anchor: its ``gram``-symbol substring with the least hash, the first of them. Equal windows
have equal anchors at equal offsets. Neighbouring windows mostly share an anchor, so a document falls into runs of windows, and a run's
symbols are its segment. Every window lies in exactly one segment, and windows that are equal lie in segments with the same
key (the anchor's hash). A key that occurs once in the corpus cannot hold a repeated window. So:

1. each task sends the keys of its runs, packed by bucket; a bucket finds the keys that occur twice or more;
2. those runs alone are cut out of their documents and sent to the key's shard, equal segments of a batch merged into one row;
3. a shard sorts by key and hands over collections of whole key groups of bounded size.

Nothing depends on the hash but the cost: unequal segments under one key are told apart by their symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, join_checked, shuffle_partitions

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Symbols handled at a time; longer documents are taken in pieces that overlap by a window.
PIECE = 1 << 20
#: Bytes of texts whose symbols are held at a time, bytes that segments of a batch may take before they leave, and what a segment and a place of it take besides its symbols.
TEXTS, HELD, SEGMENT, PLACE = 6 << 20, 64 << 20, 500, 100
#: Symbols of a collection; a larger key group is a collection of its own.
COLLECTION = 1 << 20


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each substring of ``gram`` symbols, by doubling."""
    out, have = None, 0
    h, size, base = codes.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    rest = gram
    while rest:
        if rest & 1:
            if out is None:
                out, have = h, size
            else:
                n = len(codes) - have - size + 1
                out = out[:n] * np.uint64(base) + h[have : have + n]
                have += size
        rest >>= 1
        if rest:
            n = len(h) - size
            h = h[:n] * np.uint64(base) + h[size : size + n]
            base, size = base * base % (1 << 64), size * 2
    out = out * _MIX
    out ^= out >> np.uint64(32)
    return out * _BASE


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words_of(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a text, words being runs of anything but the six ASCII white spaces. ``lower``: A-Z count as a-z.
    The hash is a polynomial in the word's bytes, taken from running sums over the whole text."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    space = _SPACES[b]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _power_tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_LOWER[b] if lower else b).astype(np.uint64) * powers[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX
    h ^= h >> np.uint64(32)
    return h * _MIX, starts, ends


@dataclass
class Runs:
    """Runs of a batch of documents: row of the batch, first and last window start in the document, anchor there, key."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def _runs_of(codes: np.ndarray, owner: np.ndarray, origin: np.ndarray, length: int, gram: int) -> Runs | None:
    """``codes``: pieces one after the other; ``owner``: each piece's number at each symbol; ``origin``: where it starts in codes."""
    n = len(codes)
    if n < length:
        return None
    span = length - gram + 1
    keys = gram_hashes(codes, gram)
    ordered = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    padded = np.full(-(-len(ordered) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(ordered)] = ordered
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    windows = n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = owner[:windows] == owner[length - 1 :]
    starts = np.flatnonzero(valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1])))
    if not len(starts):
        return None
    ends = np.flatnonzero(valid & np.concatenate(((anchor[1:] != anchor[:-1]) | ~valid[1:], [True])))
    piece = owner[starts]
    at = origin[piece]
    return Runs(piece, starts - at, ends - at, anchor[starts] - at, keys[anchor[starts]])


def runs(documents: list[np.ndarray], length: int, gram: int) -> Iterator[Runs]:
    """Runs of all documents, ordered by document and position, in batches of bounded size."""
    pieces: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[Runs]:
        codes = np.concatenate([c for _, _, c in pieces])
        sizes = np.array([len(c) for _, _, c in pieces])
        found = _runs_of(codes, np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), np.cumsum(sizes) - sizes, length, gram)
        if found is not None:
            rows, offs = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
            by = found.row
            yield Runs(rows[by], found.first + offs[by], found.last + offs[by], found.anchor + offs[by], found.key)

    for row, codes in enumerate(documents):
        if len(codes) < length:
            continue
        for lo in range(0, len(codes) - length + 1, PIECE):
            part = codes[lo : lo + PIECE + length - 1]
            pieces.append((row, lo, part))
            size += len(part)
            if size >= PIECE:
                yield from flush()
                pieces, size = [], 0
    if pieces:
        yield from flush()


@dataclass
class Group:
    """The segments of one key: distinct contents, the anchor's offset in them, and who has them: (doc_id, rid, start) arrays."""

    key: int
    contents: list[bytes] = field(default_factory=list)
    anchors: list[int] = field(default_factory=list)
    members: list[list[np.ndarray]] = field(default_factory=list)
    symbols: int = 0


@dataclass(frozen=True)
class Reader:
    """How to see a text: its symbols as numbers, and the bytes of a stretch of symbols (which determine them)."""

    codes: Callable[[str], tuple[np.ndarray, object]]
    content: Callable[[object, int, int], bytes]
    length: int
    gram: int


def row_id() -> Column:
    """A hash of doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))


def with_row_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, text): rows with equal doc_id and text are one row as far as results go, so rid may be their hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("rid"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about TEXTS bytes in a text column, a row at least."""
    ends = np.cumsum([len(x) if (x := v.as_buffer()) is not None else 0 for v in b.column(column)])
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXTS, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def candidates(docs: DataFrame, reader: Reader) -> DataFrame:
    """(rid, runs): for each document the numbers of its runs whose key occurs twice or more, as packed 32-bit integers."""
    buckets = shuffle_partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in in_parts(whole, 1)):
            rids = b.column(0).to_numpy()
            documents = [reader.codes(t.as_py() or "")[0] for t in b.column(1)]
            number = np.zeros(len(rids), np.int64)
            for r in runs(documents, reader.length, reader.gram):
                # the number of a run inside its document; documents may go on from the batch before
                firsts = np.flatnonzero(np.concatenate(([True], r.row[1:] != r.row[:-1])))
                counts = np.diff(np.append(firsts, len(r.row)))
                ordinal = np.arange(len(r.row)) - np.repeat(firsts, counts) + number[r.row]
                number[r.row[firsts]] += counts
                to = (r.key >> np.uint64(8)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                key, rid, ordinal = r.key[order], rids[r.row][order], ordinal[order].astype(np.uint32)
                used = [k for k in range(buckets) if edges[k] < edges[k + 1]]
                cols = [pa.array([a[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary()) for a in (key, rid, ordinal)]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *cols], ["bucket", "keys", "rids", "runs"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for k, kind in ((1, np.uint64), (2, np.int64), (3, np.uint32)):
                parts[k - 1] += [np.frombuffer(x.as_py(), kind) for x in b.column(k)]
        if not parts[0]:
            return
        key, rid, run = (np.concatenate(p) for p in parts)
        parts.clear()
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        yield from dealt(rid[twice], run[twice])

    def dealt(rid: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Packed by where the document goes, a row for each such place: their number does not depend on how many documents there are."""
        to = (rid.view(np.uint64) * _MIX >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(buckets + 1))
        used = [k for k in range(buckets) if edges[k] < edges[k + 1]]
        cols = [pa.array([a[order][edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary()) for a in (rid, run)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *cols], ["bucket", "rids", "runs"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], []]
        for b in batches:
            for k, kind in ((1, np.int64), (2, np.uint32)):
                parts[k - 1] += [np.frombuffer(x.as_py(), kind) for x in b.column(k)]
        if not parts[0]:
            return
        rid, run = (np.concatenate(p) for p in parts)
        parts.clear()
        order = np.argsort(rid, kind="stable")
        rid, run = rid[order], run[order]
        firsts = np.flatnonzero(np.concatenate(([True], rid[1:] != rid[:-1])))
        ends = np.append(firsts[1:], len(rid))
        for lo in range(0, len(firsts), 10_000):
            part = range(lo, min(lo + 10_000, len(firsts)))
            yield pa.RecordBatch.from_arrays([pa.array(rid[firsts[part.start : part.stop]], pa.int64()), pa.array([run[firsts[i] : ends[i]].tobytes() for i in part], pa.binary())], ["rid", "runs"])

    packed = docs.select("rid", "text").mapInArrow(send, "bucket int, keys binary, rids binary, runs binary")
    found = packed.repartition(buckets, "bucket").mapInArrow(repeated, "bucket int, rids binary, runs binary")
    return found.repartition(buckets, "bucket").mapInArrow(gathered, "rid long, runs binary")


def segments(docs: DataFrame, found: DataFrame, reader: Reader) -> DataFrame:
    """(key, anchor, content, docs, rids, starts): the segments of candidate runs; the last three are packed 64-bit integers of
    those that share the content within a batch."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            merged: dict[tuple[int, int, bytes], list[list[int]]] = {}
            size = 0
            for b in in_parts(whole, 2):
                ids = [x if x is not None else -(2**63) for x in b.column(0).to_pylist()]
                rids, wanted = b.column(1).to_numpy(), [np.unique(np.frombuffer(x.as_py(), np.uint32)) for x in b.column(3)]
                views = [reader.codes(t.as_py() or "") for t in b.column(2)]
                number = [0] * len(ids)
                for r in runs([c for c, _ in views], reader.length, reader.gram):
                    firsts = np.flatnonzero(np.concatenate(([True], r.row[1:] != r.row[:-1])))
                    for lo, hi in zip(firsts, np.append(firsts[1:], len(r.row))):
                        row = int(r.row[lo])
                        w = wanted[row]
                        mine = w[np.searchsorted(w, number[row]) : np.searchsorted(w, number[row] + hi - lo)].astype(np.int64) - number[row] + lo
                        number[row] += int(hi - lo)
                        for i in mine.tolist():
                            first = int(r.first[i])
                            content = reader.content(views[row][1], first, int(r.last[i]) + reader.length)
                            of = (int(r.key[i].astype(np.int64)), int(r.anchor[i]) - first, content)
                            at = merged.get(of)
                            if at is None:
                                at = merged[of] = [[], [], []]
                                size += len(content) + SEGMENT
                            at[0].append(ids[row])
                            at[1].append(int(rids[row]))
                            at[2].append(first)
                            size += PLACE
                    if size > HELD:
                        yield packed(merged)
                        merged, size = {}, 0
            if merged:
                yield packed(merged)

    def packed(merged: dict) -> pa.RecordBatch:
        keys = list(merged)
        cols = [pa.array([np.array(m[j], np.int64).tobytes() for m in merged.values()], pa.binary()) for j in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary()), *cols], ["key", "anchor", "content", "docs", "rids", "starts"])

    joined = join_checked(docs, found, ["rid"]).select("doc_id", "rid", "text", "runs")
    return joined.mapInArrow(cut_out, "key long, anchor int, content binary, docs binary, rids binary, starts binary")


def _column_slices(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """All 64-bit integers of a column of packed ones, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64) if offsets[-1] > offsets[0] else np.zeros(0, np.int64)
    return values, ((offsets - offsets[0]) // 8).tolist()


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Key groups of a partition sorted by key; equal contents become one with all their members."""
    now: Group | None = None
    known: dict[tuple[int, bytes], int] = {}
    for b in batches:
        packed = [_column_slices(b.column(j)) for j in (3, 4, 5)]
        at_rows = packed[0][1]
        for i, (key, anchor, content) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)))):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                now, known = Group(key), {}
            lo, hi = at_rows[i], at_rows[i + 1]
            who = [v[lo:hi] for v, _ in packed]
            at = known.get((anchor, content))
            if at is None:
                known[anchor, content] = len(now.contents)
                now.contents.append(content)
                now.anchors.append(anchor)
                now.members.append([who])
                now.symbols += len(content)
            else:
                now.members[at].append(who)
    if now is not None:
        yield now


def joined_members(members: list[list[np.ndarray]]) -> list[np.ndarray]:
    return members[0] if len(members) == 1 else [np.concatenate([m[j] for m in members]) for j in range(3)]


def collections(found: Iterator[Group]) -> Iterator[list[Group]]:
    """Groups put together up to a bounded size."""
    out: list[Group] = []
    size = 0
    for g in found:
        out.append(g)
        size += g.symbols
        if size >= COLLECTION:
            yield out
            out, size = [], 0
    if out:
        yield out


#: What a judge gives for a collection: doc_ids, rids, starts and ends of spans to remove.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def expanded(members: list[np.ndarray], which: np.ndarray, spans: np.ndarray) -> Spans:
    """The (start, end) rows of a content at each of the chosen members."""
    docs, rids, starts = (m[which] for m in members)
    k = len(spans)
    return np.repeat(docs, k), np.repeat(rids, k), (starts[:, None] + spans[:, 0]).ravel(), (starts[:, None] + spans[:, 1]).ravel()


def with_spans(docs: DataFrame, reader: Reader, judge: Callable[[list[Group]], Iterator[Spans]]) -> DataFrame:
    """(doc_id, rid, text, spans) for every document; ``spans``: array of (doc_id, start, end), null where nothing goes; those
    of another doc_id (a rid met twice) are not the document's. ``judge`` gets a collection. Both joins with the texts are on rid, so
    where both shuffle, one exchange of the texts serves both."""
    found = cut(candidates(docs, reader))
    buckets = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for collection in collections(groups(batches)):
            parts = list(judge(collection))
            if parts:
                doc, *rest = (np.concatenate([p[j] for p in parts]) for j in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == -(2**63)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "rid", "start", "end"])

    rows = segments(docs, found, reader).repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, rid long, start long, end long")
    spans = rows.groupBy("rid").agg(F.collect_list(F.struct("doc_id", "start", "end")).alias("spans"))
    return docs.hint("merge").join(spans, "rid", "left").select("doc_id", "rid", "text", "spans")


def spans_of(column: pa.Array, doc_ids: pa.Array) -> Iterator[np.ndarray]:
    """Merged (start, end) rows of each row of a batch of ``with_spans``."""
    flat = column.flatten()
    offsets = np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in column])))
    fields = [np.asarray(flat.field(j).fill_null(-(2**63))) for j in range(3)]
    for i, d in enumerate(doc_ids.to_pylist()):
        lo, hi = offsets[i], offsets[i + 1]
        if lo == hi:
            yield _NO_SPANS
            continue
        own = fields[0][lo:hi] == (-(2**63) if d is None else d)
        yield merged_spans(np.stack([fields[1][lo:hi][own], fields[2][lo:hi][own]], axis=1))


_NO_SPANS = np.zeros((0, 2), np.int64)


def merged_spans(s: np.ndarray) -> np.ndarray:
    """(start, end) rows, sorted, overlapping and touching ones joined."""
    if not len(s):
        return s
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate(([True], s[1:, 0] > reach[:-1]))
    starts = s[new, 0]
    ends = reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]
    return np.stack([starts, ends], axis=1)


def window_spans(flags: np.ndarray, length: int) -> np.ndarray:
    """(start, end) rows of the symbols that the flagged windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2] - 1 + length
    return np.stack([starts, ends], axis=1).astype(np.int64)
