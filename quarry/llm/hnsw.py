"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Vectors are dealt to shards of about ``SHARD`` by a hash of their values, so equal vectors meet; a shard keeps each distinct vector
once, with the smallest ids that have it (no more than a search can return, so no result is lost to copies). A shard's graph is a few flat arrays: the
vectors, each node's level, and for each level one row of neighbour numbers a node, padded with -1. Neighbours are chosen by the
diversity rule among the nearest nodes of the level (found by distances to the whole level of the shard, in blocks, instead of by
searches of a growing graph), links go both ways, and searches descend through the upper levels by
``WAYS`` nodes and then widen to ``EF`` candidates or more on the lowest. How many a graph needs is measured when it is built: searches for a sample of its
own vectors, each left out of its own search, are held against brute force over the shard, and the candidates double until ``RECALL`` is met. A graph works in double precision on vectors moved by the shard's median and scaled, so
neither a common offset nor the magnitude of the vectors matters.

Queries travel in blocks to every shard; a task loads a shard's graph once and streams its blocks past it. Each shard returns its best
``k`` and the best of those are the result, scored again on the original vectors in double precision.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or differ in length from the query take no part (a
table of mixed lengths is one shard space for each length); a query never finds rows of its own id, but finds other rows with equal vectors; repeated ids are
found once for each distinct row, and rows with equal id and vector are one query; with fewer candidates than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import cut

#: Vectors of a shard at most, and bytes of their components; neighbours of a node (twice as many on the lowest level), candidates of a search at least.
SHARD, SHARD_BYTES, LINKS, EF = 16_384, 32 << 20, 16, 96
#: Queries of a block, and blocks that a task streams past one loaded graph.
BLOCK, BLOCKS = 64, 64
#: Recall that a graph must show on its sample, vectors of the sample, nodes that a search opens at once, nodes of an upper level it goes down from.
RECALL, PROBES, WIDE, WAYS = 0.95, 64, 8, 32


class Graph:
    """An HNSW graph over the rows of ``vectors`` (distinct)."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        n = len(vectors)
        x = np.asarray(vectors, np.float64)
        top = float(np.abs(x).max(initial=0)) or 1.0
        self.unit = 2.0 ** -np.frexp(top)[1]  # largest component to about one, so that nothing overflows
        self.middle = np.median(x * self.unit, axis=0) if n else 0.0
        self.stretch = 1e100 / (float(np.abs(x * self.unit - self.middle).max(initial=0)) or 1.0)  # and small differences keep their squares
        self.vectors = self.placed(x)
        # levels from the vectors' own hashes: the same shard always gets the same graph
        u = np.array([(xxhash.xxh3_64_intdigest(v.tobytes()) >> 11) / 2**53 for v in self.vectors]) if n else np.zeros(0)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(np.int8), 12)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.layers: list[np.ndarray] = []
        for level in range(int(self.level.max(initial=0)) + 1):
            self.layers.append(self._layer(np.flatnonzero(self.level >= level), 2 * links if level == 0 else links, links))
        self.entry = int(np.argmax(self.level)) if n else -1

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the graph holds them: distances keep their order."""
        return (x * self.unit - self.middle) * self.stretch

    def _layer(self, nodes: np.ndarray, most: int, links: int) -> np.ndarray:
        """Neighbours on one level, for all nodes (rows of nodes above or below stay empty)."""
        out = np.full((len(self.vectors), most), -1, np.int32)
        x = self.vectors[nodes]
        near = min(len(nodes) - 1, 4 * links)
        if near < 1:
            return out
        chosen: list[list[int]] = []
        for lo in range(0, len(nodes), 512):
            d = self.norms[nodes[lo : lo + 512], None] + self.norms[None, nodes] - 2 * (x[lo : lo + 512] @ x.T)
            d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
            cand = np.argpartition(d, near - 1, axis=1)[:, :near]
            cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(d, cand, axis=1), axis=1, kind="stable"), axis=1)
            for i, c in enumerate(cand):
                between = self.norms[nodes[c], None] + self.norms[None, nodes[c]] - 2 * (x[c] @ x[c].T)
                chosen.append(self._diverse(c, d[i, c], between, links))
        both: list[dict[int, None]] = [dict.fromkeys(c) for c in chosen]
        for i, c in enumerate(chosen):
            for j in c:
                both[j].setdefault(i)
        for i, c in enumerate(both):
            c = np.fromiter(c, np.int64)
            if len(c) > most:  # the diverse ones stay
                d = ((x[c] - x[i]) ** 2).sum(axis=1)
                c = c[np.argsort(d, kind="stable")]
                kept = self._diverse(c, np.sort(d), self.norms[nodes[c], None] + self.norms[None, nodes[c]] - 2 * (x[c] @ x[c].T), most)
                c = np.array(kept)
            out[nodes[i], : len(c)] = nodes[c]
        return out

    @staticmethod
    def _diverse(cand: np.ndarray, d: np.ndarray, between: np.ndarray, most: int) -> list[int]:
        """Candidates, nearest first, that are nearer to the node than to those chosen before; the nearest others fill up."""
        keep: list[int] = []
        least = np.full(len(cand), np.inf)
        for i in range(len(cand)):
            if d[i] < least[i]:
                keep.append(i)
                if len(keep) == most:
                    break
                least = np.minimum(least, between[i])
        taken = set(keep)
        keep += [i for i in range(len(cand)) if i not in taken][: most - len(keep)]
        return cand[keep].tolist()

    def enough(self, k: int, ef: int) -> int:
        """``ef``, doubled until searches for the ``k`` nearest of a spread sample of rows meet ``RECALL`` against brute force."""
        rows = np.setdiff1d(np.flatnonzero(self.level == 0), [self.entry])  # the way down never starts at the row itself
        rows = rows[np.unique(np.linspace(0, len(rows) - 1, min(PROBES, len(rows))).astype(int))] if len(rows) else rows
        k = min(k, len(self.vectors) - 1)
        far = []  # distance of the k-th nearest other row
        for i in rows:
            d = ((self.vectors - self.vectors[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            far.append(float(np.partition(d, k - 1)[k - 1]))
        while ef < len(self.vectors):
            met = sum(sum(d <= f for d, _ in self._nearest(self.vectors[i], ef, i)[:k]) for i, f in zip(rows, far))
            if met >= RECALL * k * len(rows):
                break
            ef *= 2
        return ef

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """(squared distance, row) of the ``ef`` nearest found, nearest first."""
        return self._nearest(self.placed(q), ef) if self.entry >= 0 else []

    def _nearest(self, q: np.ndarray, ef: int, without: int | None = None) -> list[tuple[float, int]]:
        """The search for a placed vector, as if the row ``without`` were not there."""
        starts = [(float(((self.vectors[self.entry] - q) ** 2).sum()), self.entry)]
        for layer in self.layers[:0:-1]:  # several ways down: a cluster may hang on one of them only
            starts = self._widened(layer, q, min(ef, WAYS), starts, without)
        return self._widened(self.layers[0], q, ef, starts, without)

    def _widened(self, layer: np.ndarray, q: np.ndarray, ef: int, starts: list[tuple[float, int]], without: int | None) -> list[tuple[float, int]]:
        """The ``ef`` nearest found on one level, nearest first, from ``starts``."""
        seen = np.zeros(len(self.vectors), bool)
        seen[[i for _, i in starts]] = True
        if without is not None:
            seen[without] = True
        open_, found = sorted(starts), [(-d, i) for d, i in sorted(starts)[:ef]]
        heapq.heapify(found)
        while open_ and (len(found) < ef or open_[0][0] <= -found[0][0]):
            around = layer[[heapq.heappop(open_)[1] for _ in range(min(WIDE, len(open_)))]]
            around = around[around >= 0]
            around = np.unique(around[~seen[around]])
            if not len(around):
                continue
            seen[around] = True
            d = ((self.vectors[around] - q) ** 2).sum(axis=1)
            if len(found) >= ef:
                nearer = d < -found[0][0]
                d, around = d[nearer], around[nearer]
            for e, j in zip(d.tolist(), around.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (-e, j))
                    heapq.heappush(open_, (e, j))
                elif e < -found[0][0]:
                    heapq.heapreplace(found, (-e, j))
                    heapq.heappush(open_, (e, j))
        return sorted((-d, i) for d, i in found)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(finite, F.lit(False))).where(F.exists("embedding", lambda x: x != 0))


def build(vectors: DataFrame, shards: int, k: int, ef: int = EF) -> DataFrame:
    """(shard, graph): a row for each shard and vector length, with its pickled flat arrays and the candidates that its searches need."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest k + 1 ids of each distinct vector of a batch."""
        for b in batches:
            ids: dict[bytes, list[int]] = {}
            for i, e in zip(b.column(0).to_pylist(), b.column(1)):
                ids.setdefault(np.array(e.values, np.float64).tobytes(), []).append(i)
            rows = [(xxhash.xxh3_64_intdigest(v) % shards, heapq.nsmallest(k + 1, i), v) for v, i in ids.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())], ["shard", "ids", "vector"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, {}

        def done() -> pa.RecordBatch:
            keys = sorted(ids)
            exact = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
            graph = Graph(exact)
            data = pickle.dumps((exact, [sorted(ids[x]) for x in keys], graph, graph.enough(k, ef)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([data], pa.binary())], ["shard", "length", "graph"])

        for b in batches:
            for s, size, i, v in zip(*(b.column(j).to_pylist() for j in range(4))):
                if (s, size) != now:
                    if now is not None:
                        yield done()
                    now, ids = (s, size), {}
                ids[v] = heapq.nsmallest(k + 1, ids.get(v, []) + i)
        if now is not None:
            yield done()

    thinned = vectors.mapInArrow(thin, "shard int, ids array<long>, vector binary").withColumn("length", (F.octet_length("vector") / 8).cast("int"))
    return thinned.select("shard", "length", "ids", "vector").repartition(4 * shards, "shard").sortWithinPartitions("shard", "length").mapInArrow(make, "shard int, length int, graph binary")


def search(vectors: DataFrame, is_query: Column, k: int = 10, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row of ``vectors`` that meets ``is_query``; searches keep ``ef`` candidates or more."""
    rows = cut(usable(vectors))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    shards = max(1, -(-n // max(1, min(SHARD, SHARD_BYTES // (8 * longest)))))
    graphs = cut(build(rows, shards, k, ef))
    queries = rows.where(is_query).dropDuplicates(["vec_id", "embedding"])
    blocks = max(1, -(-queries.count() // BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple[int, int], list[tuple[int, bytes]]] = {}  # (block, length)
            for block, i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                v = np.array(e.values, np.float64)
                by.setdefault((block, len(v)), []).append((i, v.tobytes()))
            keys = list(by)
            cols = [pa.array([x[1] for x in keys], pa.int32()), pa.array([x[0] // BLOCKS for x in keys], pa.int32()), pa.array([pickle.dumps(by[x]) for x in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["length", "part", "queries"])

    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select("block", "vec_id", "embedding").repartition(blocks, "block").mapInArrow(pack, "length int, part int, queries binary")
    # each block of the stated query set goes to every shard of its length, and the shard's graph once to every task that has blocks for it
    parts = -(-blocks // BLOCKS)
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    sent = packed.select(shard, "length", "part", F.lit(1).alias("kind"), F.col("queries").alias("data"))
    held = graphs.select("shard", "length", part, F.lit(0).alias("kind"), F.col("graph").alias("data"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loaded = None, None
        for b in batches:
            for s, size, part, kind, data in zip(*(b.column(j) for j in range(5))):
                if not kind.as_py():
                    now, loaded = (s.as_py(), size.as_py(), part.as_py()), pickle.loads(data.as_buffer())
                    continue
                if now != (s.as_py(), size.as_py(), part.as_py()):
                    continue  # no vector of this length in the shard
                exact, ids, graph, wide = loaded
                out: tuple[list, list, list] = ([], [], [])
                for i, raw in pickle.loads(data.as_buffer()):
                    q = np.frombuffer(raw, np.float64)
                    near = [j for _, j in graph.search(q, wide)]
                    score = np.sqrt(np.cumsum((exact[near] - q) ** 2, axis=1)[:, -1])
                    best = heapq.nsmallest(k, ((s, c) for s, j in zip(score.tolist(), near) for c in ids[j] if c != i))
                    for d, c in best:
                        out[0].append(i)
                        out[1].append(c)
                        out[2].append(d)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    # few keys: more partitions, so that they seldom meet; a shuffle brings rows in any order, the sort puts each graph right before its own queries
    together = held.unionAll(sent).repartition(4 * shards * parts, "shard", "part").sortWithinPartitions("shard", "length", "part", "kind")
    hits = together.mapInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple[int, list]], query_ids: set[int], k: int) -> list[tuple[int, int, int, float]]:
    """(query_id, rank, vec_id, score) by the definition, for tests."""
    def good(e: list | None) -> bool:
        return bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)

    live = [(i, np.array(e, np.float64)) for i, e in rows if i is not None and good(e)]
    out = []
    for q, e in live:
        if q in query_ids:
            near = sorted((float(np.sqrt(np.cumsum((v - e) ** 2)[-1])), i) for i, v in live if i != q and len(v) == len(e))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return out
