"""Exact n-gram Jaccard join of texts, as a join in the metric space of Jaccard distance.

A text's set: its distinct ``words``-word shingles as 64-bit hashes (fewer words: the whole sequence as one). Equal sets are one class; the join
is over classes.

1. Cells. Sets within the threshold have a shingle in common among the rarest few of each, whatever order of rarity all sets share (prefix
   filter). Rarity is counted over all classes in a fixed number of hash buckets, so a passage of many documents is seldom among a set's
   rarest shingles. A cell is all classes that have one shingle there; its first class in hash order is its pivot. Classes that
   share no cell with another have no link and take no further part.
2. Neighbourhoods. Each class has a parity sketch, about one bit a shingle: the bits in which two sketches differ are never more than
   the shingles in which their sets differ, so a pair whose sketches differ too much has no link. Sketches, not sets, travel to the cells'
   pivots; the pairs that the sketches allow there connect classes to neighbourhoods. Every link lies inside one neighbourhood.
3. Regions. A set travels to its neighbourhood once. One that fits a task is joined there. A larger one gets pivots of its own: the
   distances to them are exact, links to pivots are taken at once, each class is at home in its nearest pivot's Voronoi region and is
   replicated to every region whose pivot is no more than twice the threshold farther (triangle inequality). Regions that
   are connected already are done; the others are joined the same way again, with other pivots. A region that no longer shrinks is joined in pairs of blocks.
4. Inside a task a few of its sets become pivots, and sets in order of (nearest pivot, distance) form blocks. A pair of blocks is
   compared only if, for every pivot, their distance intervals come within the threshold of each other. Overlaps of a pair of
   blocks come from one matrix product over the shingles that two sets or more have.

Links are reduced to a spanning forest where they are found: a group of n near copies gives n - 1 edges, and pairs already connected are
not compared. Components come from alternating stars.

Defined results: null texts and texts without words have empty sets, no links, and are their own component; n rows with equal sets are
linked; repeated rows likewise; a component is named by its least doc_id (null only if it has no other); further columns are
ignored; texts of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.anchors import gram_hashes, row_id, with_row_ids, words_of
from quarry.llm.components import components
from quarry.session import cut, join_checked, shuffle_partitions

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Shingles that a task joins at a time, sketches that a task compares at a time, pivots of a region that exceeds a task.
REGION, SKETCHES, CENTRES = 1 << 21, 4096, 8
#: Bytes of sets that leave a worker at a time.
PIECE = 4 << 20
#: Binary logarithm of the hash buckets in which shingles are counted (16 MB), buckets of a row of counts.
BUCKETS, SLOT = 22, 1 << 14
#: Sets of a block inside a region, pivots of a region, shingles of a slice of the matrix product.
ROWS, PIVOTS, SLICE = 256, 8, 1 << 14


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    codes = words_of(text.encode("utf-8", "surrogatepass"), lower=True)[0]
    return np.unique(gram_hashes(codes, min(words, len(codes)))) if len(codes) else np.zeros(0, np.uint64)


def _class(s: np.ndarray) -> int:
    return int(np.int64(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))) if len(s) else 0


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s * _M2 >> np.uint64(64 - BUCKETS)).astype(np.int64)


def rarest(s: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The shingles of the set's cells: so many of the rarest that two sets within the threshold have one in common."""
    n = len(s)
    if 100 * n < percent * (n + 1):
        return s[:0]  # only equal sets
    return s[np.argsort(counts[bucket_of(s)], kind="stable")[: n + percent * n // -100 + 1]]


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in hash buckets, at least as many buckets as shingles (a power of two)."""
    if not len(s):
        return b""
    buckets = max(64, 1 << (len(s) - 1).bit_length())
    at = s * _M2
    at ^= at >> np.uint64(33)
    parity = np.bincount((at * _M1 >> np.uint64(20)).astype(np.int64) & (buckets - 1), minlength=buckets) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches and set sizes of some classes, compared many pairs at a time."""

    def __init__(self, raw: list[bytes], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        self.width = np.array([len(x) // 8 for x in raw], np.int64)
        self.row = np.zeros(len(raw), np.int64)
        self.bits: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.row[mine] = np.arange(len(mine))
            self.bits[w] = np.frombuffer(b"".join(raw[i] for i in mine), np.uint64).reshape(len(mine), w)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sketches allow that sets i and j are within the threshold; never false for those that are."""
        both = (self.sizes[i] + self.sizes[j]) * (100 - self.percent)
        out = np.abs(self.sizes[i] - self.sizes[j]) * (100 + self.percent) <= both
        rest = np.flatnonzero(out)
        kinds = self.width[i[rest]] << 32 | self.width[j[rest]]
        for kind in np.unique(kinds).tolist():
            wi, wj = kind >> 32, kind & 0xFFFFFFFF
            w = min(wi, wj)
            mine = rest[kinds == kind]
            for lo in range(0, len(mine), step := max(1, (1 << 20) // max(wi, wj))):
                at = mine[lo : lo + step]
                a, b = self.bits[wi][self.row[i[at]]], self.bits[wj][self.row[j[at]]]
                a, b = (x if x.shape[1] == w else np.bitwise_xor.reduce(x.reshape(len(x), -1, w), axis=1) for x in (a, b))
                out[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) * (100 + self.percent) <= both[at]
        return out


def sets_table(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, rid, n, cls, sketch) of each document's set, its class and its sketch; rows with a ``slot`` hold a task's
    counts of shingles instead: ``sketch`` is that part of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << BUCKETS, np.uint32), set()
        names = ["doc_id", "rid", "n", "cls", "sketch", "slot"]
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(2)]
            classes = [_class(s) for s in sets]
            for c, s in zip(classes, sets):
                if c not in seen:  # copies that one task meets count once
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    np.add.at(counts, bucket_of(s), 1)
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own, pa.nulls(len(sets), pa.int32())], names)
        for k, part in enumerate(counts.reshape(-1, SLOT)):
            if part.any():
                packed = zlib.compress(part.astype(np.min_scalar_type(part.max())).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([packed], pa.binary()), pa.array([k], pa.int32())], names)

    return rows.mapInArrow(run, "doc_id long, rid long, n long, cls long, sketch binary, slot int")


def shingle_counts(table: DataFrame) -> np.ndarray:
    """In how many classes the shingles of a hash bucket occur, at least; of a fixed size whatever the input's is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                raw = zlib.decompress(x.as_py())
                part = np.frombuffer(raw, f"u{len(raw) // SLOT}")
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slot", "counts"])

    out = np.zeros((1 << BUCKETS) // SLOT * SLOT, np.uint64).reshape(-1, SLOT)
    parts = table.where("slot IS NOT NULL").select("slot", "sketch")
    for k, part in parts.repartition(shuffle_partitions(table.sparkSession), "slot").mapInArrow(add, "slot int, counts binary").collect():
        out[k] = np.frombuffer(part, np.uint64)
    return np.minimum(out.ravel(), 0xFFFFFFFF).astype(np.uint32)


def shared_cells(rows: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(pivot, cls): the regions that each class belongs to, for cells of two classes or more; pivots are in their own."""
    buckets = shuffle_partitions(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies that one task meets are sent once
        for b in batches:
            sigs, of = [], []
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                c = _class(s)
                if len(s) and c not in sent:
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(c)
                    sigs.append(rarest(s, percent, shared.value))
                    of.append(c)
            if not sigs:
                continue
            cls = np.repeat(np.array(of, np.int64), [len(x) for x in sigs])
            sig = np.concatenate(sigs) * _M1
            to = (sig >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            low, cls = sig[order].astype(np.uint32), cls[order]
            used = [k for k in range(buckets) if edges[k] < edges[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([a[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary()) for a in (low, cls))], ["bucket", "sigs", "classes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, classes = [], []
        for b in batches:
            sigs += [np.frombuffer(x.as_py(), np.uint32) for x in b.column(1)]
            classes += [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
        if not sigs:
            return
        sig, cls = np.concatenate(sigs), np.concatenate(classes)
        del sigs, classes
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        sig, cls = sig[order], cls[order]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        first = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
        pivot = cls[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(sig) else cls
        keep = pivot != cls
        pairs = np.unique(np.stack([pivot[keep], cls[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
        for lo in range(0, len(pairs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + 10_000, 0]), pa.array(pairs[lo : lo + 10_000, 1])], ["pivot", "cls"])

    packed = rows.select("text").mapInArrow(send, "bucket int, sigs binary, classes binary")
    pairs = packed.repartition(buckets, "bucket").mapInArrow(meet, "pivot long, cls long").distinct()
    return pairs


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Sizes of the intersections of each of a with each of b; members are numbers below ``width``."""
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, width, SLICE):
        dense = []
        for side in (a, b):
            m = np.zeros((len(side), min(SLICE, width - lo)), np.float32)
            for i, x in enumerate(side):
                m[i, x[np.searchsorted(x, lo) : np.searchsorted(x, lo + SLICE)] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def region_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of a set of its connected group, the least. ``side``: only pairs across sides 0 and 1 need be looked for."""
    m = len(sets)
    root = np.arange(m)
    sizes = np.array([len(s) for s in sets])
    alive = np.arange(m)
    # a set with a link shares percent of its shingles with one other set, so with the rest of the region
    flat = np.concatenate(sets)
    inverse = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    while True:
        times = np.bincount(inverse)
        shared = np.bincount(owner, times[inverse] > 1, m)
        ok = 100 * shared >= percent * sizes
        if ok[alive].all():
            break
        keep = ok[owner]
        inverse, owner = inverse[keep], owner[keep]
        alive = alive[ok[alive]]
        if len(alive) < 2:
            return root
    keep = times[inverse] > 1
    inverse, owner = np.unique(inverse[keep], return_inverse=True)[1], owner[keep]
    order = np.lexsort((inverse, owner))
    inverse, owner = inverse[order], owner[order]
    width = int(inverse.max()) + 1 if len(inverse) else 0
    starts = np.searchsorted(owner, alive)
    members = [inverse[a:b] for a, b in zip(starts, np.append(starts[1:], len(inverse)))]
    n, k = len(alive), sizes[alive]

    def linked(i: np.ndarray, j: np.ndarray, inter: np.ndarray) -> np.ndarray:
        inter = np.rint(inter).astype(np.int64)
        return 100 * inter >= percent * (k[i] + k[j] - inter)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(alive[i].tolist(), alive[j].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)

    far = 1 - percent / 100 + 1e-6
    if n > ROWS:
        chosen = [0]
        gap = np.full(n, 2.0)
        distance = []
        for _ in range(PIVOTS):  # each next pivot is the set that is farthest from those before
            inter = _overlaps([members[chosen[-1]]], members, width)[0]
            d = 1 - inter / (k[chosen[-1]] + k - inter)
            distance.append(d)
            hits = np.flatnonzero(linked(np.full(n, chosen[-1]), np.arange(n), inter) & (True if side is None else side[alive] != side[alive[chosen[-1]]]))
            union(hits, np.full(len(hits), chosen[-1]))
            gap = np.minimum(gap, d)
            chosen.append(int(np.argmax(gap)))
        distance = np.array(distance)
        home = np.argmin(distance, axis=0)
        order = np.lexsort((distance[home, np.arange(n)], home))
    else:
        distance = np.zeros((1, n))
        order = np.argsort(k, kind="stable")
    blocks = [order[i : i + ROWS] for i in range(0, n, ROWS)]
    low, high = (np.array([f(distance[:, b], axis=1) for b in blocks]) for f in (np.min, np.max))
    least, most = np.array([k[b].min() for b in blocks]), np.array([k[b].max() for b in blocks])
    for x, a in enumerate(blocks):
        for y in range(x, len(blocks)):
            b = blocks[y]
            if (low[x] > high[y] + far).any() or (low[y] > high[x] + far).any():
                continue
            if 100 * most[y] < percent * least[x] or 100 * most[x] < percent * least[y]:
                continue
            ra, rb = (np.array([find(i) for i in alive[z].tolist()]) for z in (a, b))
            if len(a) == len(b) == 1 and x == y or (ra == ra[0]).all() and (rb == ra[0]).all():
                continue
            inter = _overlaps([members[i] for i in a], [members[i] for i in b], width)
            i, j = np.nonzero((inter > 0) & (ra[:, None] != rb[None, :]))
            if x == y:
                i, j = i[i < j], j[i < j]
            if side is not None:
                across = side[alive[a[i]]] != side[alive[b[j]]]
                i, j = i[across], j[across]
            hit = linked(a[i], b[j], inter[i, j])
            union(a[i[hit]], b[j[hit]])
    return np.array([find(i) for i in range(m)])


class Forest:
    """Connected groups of numbers met so far."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in self.root]
        pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def allowed_edges(regions: list[tuple[np.ndarray, np.ndarray | None]], cls: np.ndarray, sketches: Sketches) -> pa.RecordBatch:
    """Edges that connect what the sketches allow to be linked inside each region: (numbers of its classes, their sides or None)."""
    forest = Forest()
    small: dict[int, list[np.ndarray]] = {}
    for who, side in regions:
        if len(who) <= 32 and side is None:
            small.setdefault(len(who), []).append(who)
            continue
        left = np.ones(len(who), bool)  # every class is compared once with those not yet reached
        for seed in range(len(who)):
            if not left[seed]:
                continue
            left[seed], open_ = False, [seed]
            while open_:
                x = open_.pop()
                rest = np.flatnonzero(left if side is None else left & (side != side[x]))
                if not len(rest):
                    continue
                hit = rest[sketches.may_link(np.full(len(rest), who[x]), who[rest])]
                left[hit] = False
                open_ += hit.tolist()
                for y in hit.tolist():
                    forest.union(int(cls[who[x]]), int(cls[who[y]]))
    for m, groups in small.items():
        i, j = np.triu_indices(m, 1)
        for lo in range(0, len(groups), step := max(1, (1 << 18) // len(i))):
            who = np.stack(groups[lo : lo + step])
            a, b = who[:, i].ravel(), who[:, j].ravel()
            hit = sketches.may_link(a, b)
            for x, y in zip(cls[a[hit]].tolist(), cls[b[hit]].tolist()):
                forest.union(x, y)
    return forest.edges()


def neighbourhoods(member: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(cls, region) for every class that the sketches allow a link; linked classes have one region."""
    blocks = F.ceil(F.count("*") / SKETCHES).cast("int")
    placed = member.join(member.groupBy("pivot").agg(blocks.alias("blocks")), "pivot").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pivot", "cls", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rest: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            pivot, i, j, cls, mine, n = (t.column(k).to_numpy() for k in range(6))
            starts = np.flatnonzero(np.concatenate(([True], (pivot[1:] != pivot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            ends = np.append(starts[1:], len(pivot))
            held.clear()
            if not rest:  # the last region may go on
                last = t.slice(int(starts[-1])).combine_chunks().to_batches()
                held.extend(last)
                starts, ends = starts[:-1], ends[:-1]
            regions = [(np.arange(a, e), None if i[a] == j[a] else mine[a:e] == i[a]) for a, e in zip(starts.tolist(), ends.tolist()) if e - a > 1]
            if regions:
                yield allowed_edges(regions, cls, Sketches(t.column(6).to_pylist(), n, percent))

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield from done(False)
                rows = sum(x.num_rows for x in held)
        if held:
            yield from done(True)

    together = tasks.join(reps.select("cls", "n", "sketch"), "cls").select("pivot", "i", "j", "cls", "mine", "n", "sketch")
    buckets = shuffle_partitions(member.sparkSession)
    edges = together.repartition(buckets, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(compare, "a long, b long")
    return components(edges).select(F.col("node").alias("cls"), F.col("root").alias("region"))


def _with_sets(rows: DataFrame, tasks: DataFrame, words: int) -> DataFrame:
    """``tasks`` (cut; rid first) with ``members``, the set of the text."""
    names = [c for c in tasks.columns if c != "rid"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[int, bytes] = {}  # a class that goes to several tasks is shingled once
            out, lo, held = [], 0, 0
            for k, (c, t) in enumerate(zip(b.column(names.index("cls")).to_pylist(), b.column(len(names))), 1):
                if c not in known:
                    known = {c: shingles(t.as_py(), words).tobytes()}
                out.append(known[c])
                held += len(known[c])
                if held >= PIECE or k == b.num_rows:  # sets outgrow texts: a batch leaves in pieces
                    yield pa.RecordBatch.from_arrays([*(x.slice(lo, k - lo) for x in b.columns[: len(names)]), pa.array(out, pa.binary())], [*names, "members"])
                    out, lo, held = [], k, 0

    joined = join_checked(rows.select("rid", "text"), tasks, ["rid"]).select(*names, "text")
    return joined.mapInArrow(sets, ", ".join(f"{c} {k}" for c, k in tasks.select(*names).dtypes) + ", members binary")


def _joined(rows: DataFrame, tasks: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): edges of the links inside each task (region, i, j); where i and j differ, of those between the two blocks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cls, mine, members = None, [], [], []

        def done() -> pa.RecordBatch:
            side = np.array(mine)
            root = region_links(members, percent, None if now[1] == now[2] else (side == now[1]).astype(np.int8))
            edge = np.flatnonzero(root != np.arange(len(root)))
            ids = np.array(cls, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[edge]), pa.array(ids[root[edge]])], ["a", "b"])

        for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            for region, i, j, c, s, x in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (region, i, j) != now:
                    if len(cls) > 1:
                        yield done()
                    now, cls, mine, members = (region, i, j), [], [], []
                if not cls or cls[-1] != c:  # equal rows come twice
                    cls.append(c)
                    mine.append(s)
                    members.append(np.frombuffer(x, np.uint64))
        if len(cls) > 1:
            yield done()

    together = _with_sets(rows, tasks, words).select("region", "i", "j", "cls", "mine", "members")
    return together.repartition(shuffle_partitions(rows.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j", "cls").mapInArrow(join, "a long, b long")


def _measured(rows: DataFrame, large: DataFrame, depth: int, words: int, percent: int) -> DataFrame:
    """(region, cls, near): the pivots of each class's region, with distance and whether they are linked. ``large``: (region, cls, rid, total)."""
    chunks = F.ceil(F.col("total") / REGION)
    centre = F.pmod(F.xxhash64("cls", F.lit(depth)), F.lit(CENTRES))
    pivots = large.groupBy("region", centre.alias("centre")).agg(F.min(F.struct("cls", "rid")).alias("p"), F.max(chunks).alias("chunks"))
    pivots = pivots.select("p.rid", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "p.cls")
    tasks = cut(pivots.unionAll(large.select("rid", "region", F.pmod(F.xxhash64("cls", F.lit(-1 - depth)), chunks).alias("chunk"), F.lit(1).alias("role"), "cls")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres = None, {}
        for b in batches:
            out: list[list] = [[], [], []]
            for region, chunk, role, c, x in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (region, chunk) != now:
                    now, centres = (region, chunk), {}
                s = np.frombuffer(x, np.uint64)
                if not role:
                    centres[c] = s
                    continue
                near = []
                for p, other in centres.items():
                    inter = len(np.intersect1d(s, other, assume_unique=True))
                    union = len(s) + len(other) - inter
                    near.append({"pivot": p, "d": 1 - inter / union, "linked": 100 * inter >= percent * union})
                for o, v in zip(out, (region, c, near)):
                    o.append(v)
            kind = pa.list_(pa.struct([("pivot", pa.int64()), ("d", pa.float64()), ("linked", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], ["region", "cls", "near"])

    together = _with_sets(rows, tasks, words).select("region", "chunk", "role", "cls", "members")
    return together.repartition(shuffle_partitions(rows.sparkSession), "region", "chunk").sortWithinPartitions("region", "chunk", "role").mapInArrow(measure, "region long, cls long, near array<struct<pivot: long, d: double, linked: boolean>>")


def region_edges(rows: DataFrame, member: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): edges between classes whose components are those of all links inside regions. ``member``: (region, cls, rid, n)."""
    single = (F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("mine"))
    out, depth, far = [], 0, 2 * (1 - percent / 100) + 1e-6
    member = member.withColumn("parent", F.lit(None).cast("long"))
    while True:
        member = cut(member.join(member.groupBy("region").agg(F.sum("n").alias("total")), "region"))
        out.append(_joined(rows, cut(member.where(F.col("total") <= REGION).select("rid", "region", *single, "cls")), words, percent))
        large = member.where(F.col("total") > REGION)
        if large.isEmpty():
            break
        stuck = F.coalesce(F.col("total") > 0.9 * F.col("parent"), F.lit(False))
        # no pivot divides it further: pairs of blocks
        blocks = F.ceil(F.col("total") / REGION).cast("int")
        rest = large.where(stuck).withColumn("mine", F.pmod(F.xxhash64("cls"), blocks.cast("long")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        out.append(_joined(rows, cut(rest.select("rid", "region", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls")), words, percent))
        large = large.where(~stuck)
        near = cut(_measured(rows, large.select("region", "cls", "rid", "total"), depth, words, percent).dropDuplicates(["region", "cls"]))
        hits = near.select(F.col("cls").alias("a"), F.explode("near").alias("p")).where("p.linked").select("a", F.col("p.pivot").alias("b"))
        out.append(hits)
        group = components(hits).select(F.col("node").alias("cls"), "root")
        home = F.array_min(F.transform("near", lambda x: x["d"]))
        guests = near.withColumn("home", home).select("region", "cls", F.explode("near").alias("p"), "home").where(F.col("p.d") <= F.col("home") + far)
        guests = guests.join(large.select("region", "cls", "rid", "n", F.col("total").alias("parent")), ["region", "cls"]).join(group, "cls", "left")
        guests = cut(guests.select(F.xxhash64("region", "p.pivot").alias("region"), "cls", "rid", "n", "parent", F.coalesce("root", "cls").alias("root")))
        open_ = guests.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("region")
        member = guests.drop("root").join(open_, "region", "left_semi")
        depth += 1
    edges = out[0]
    for x in out[1:]:
        edges = edges.unionAll(x)
    return edges


def links(rows: DataFrame, table: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(a, b): edges between classes whose components are those of all links."""
    pairs = cut(shared_cells(rows, words, percent, counts))
    member = pairs.unionAll(pairs.select("pivot", "pivot").distinct())
    wanted = member.select("cls").distinct()
    known = table.where("n > 0").groupBy("cls").agg(F.min(F.struct("rid", "n", "sketch")).alias("r"))
    reps = cut(known.join(wanted, "cls", "left_semi").select("cls", "r.rid", "r.n", "r.sketch"))
    near = cut(neighbourhoods(member, reps, percent))
    return region_edges(rows, near.join(reps.select("cls", "rid", "n"), "cls").select("region", "cls", "rid", "n"), words, percent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, rid, n_shingles, component_id, root) for each row; ``root`` names the component, null for empty sets: texts whose sets have a Jaccard similarity of ``percent`` or more are linked."""
    if not 50 <= percent <= 100 or words < 1:
        raise ValueError("percent must be from 50 to 100, words at least 1")
    rows = with_row_ids(docs)
    made = cut(sets_table(rows, words))
    table = made.where("slot IS NULL").drop("slot")
    roots = cut(components(links(rows, table, shingle_counts(made), words, percent)).withColumnRenamed("node", "cls"))
    rooted = join_checked(table.drop("sketch"), roots, ["cls"], "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "cls")))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", "rid", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "root")


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id (null last), and all with empty sets."""
    found = cut(near_duplicates(docs, words, percent))
    kept = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")).select("first.rid")
    kept = cut(kept.unionAll(found.where("root IS NULL").select("rid")).distinct())
    out = join_checked(docs.withColumn("_rid", row_id()), kept.withColumnRenamed("rid", "_rid"), ["_rid"], "left_semi")
    if found.where("root IS NOT NULL").groupBy("rid").count().where("count > 1").limit(1).count():  # equal rows: one stays
        empty = out.where(F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")), F.lit(0)) == 0)
        out = out.where(F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")), F.lit(0)) > 0).dropDuplicates(["_rid"]).unionByName(empty)
    return out.select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]], words: int, percent: int) -> list[tuple[int, int, int]]:
    """(doc_id, set size, component) by the definition, for tests."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
