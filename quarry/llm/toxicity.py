"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 6 characters of a text, ASCII lower-cased and hashed to 2^20 buckets. On labelled texts each
bucket gets its log-count ratio r = log((p / |p|) / (q / |q|)), p and q being how many toxic and clean texts have it (plus 1). The
buckets that tell the classes apart most surely are kept, and a logistic regression with L2 penalty is fitted on features of value r
(over the fourth root of how common the bucket is, so that the penalty does not silence rare, telling n-grams).

Training takes a bounded, documented sample: up to ``per_class`` labelled rows of each class, lowest hash of doc_id first; the texts are
read whole, on the executors, and only counts for each bucket and the kept buckets of the sample reach the driver.

Defined results: null and empty texts have no features and get the score of the intercept, less than 0.5; labels that are null or neither 0
nor 1 are not used, a doc_id labelled twice takes the higher label; without labels of both classes every score is the base rate (0
without labels); repeated rows score alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

SIZES = (3, 4, 5, 6)
BITS = 20
#: Bound of the training sample, rows of each class.
PER_CLASS = 4000
#: Buckets that the regression sees.
KEPT = 4000
#: Most that the intercept may be: a text without any feature is not toxic.
NO_FEATURES = -0.5
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters hashed at a time.
CHUNK = 1 << 20


def hashed(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the text, with repeats, in pieces of bounded size."""
    text = text.translate(_LOWER) if not text.islower() else text
    for lo in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[lo : lo + CHUNK + SIZES[-1] - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        own = min(CHUNK, len(text) - lo)
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, SIZES[-1] + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * _STEP + codes[n - 1 :] + np.uint64(1)
            if n in SIZES:
                yield ((h[:own] * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


_LOWER = {i: i + 32 for i in range(65, 91)}


def features(text: str | None) -> np.ndarray:
    found = list(hashed(text or ""))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    """``weights``: for each bucket, regression weight times log-count ratio; 0 where the bucket is not used."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        total, seen = self.intercept, []
        for ids in hashed(text or ""):
            w = self.weights[ids]
            hit = np.flatnonzero(w)
            if len(hit):
                seen.append(ids[hit])
        if seen:
            total += float(self.weights[np.unique(np.concatenate(seen))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def _regress(starts: np.ndarray, ids: np.ndarray, y: np.ndarray, r: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps, both classes weighing alike; rows are slices of ``ids``."""
    n, k = len(y), len(r)
    sizes = np.diff(np.append(starts, len(ids)))
    row_of = np.repeat(np.arange(n), sizes)
    values = r[ids]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    # a bound of the curvature: the mean squared length of a row
    step = 4 / (1 + float(np.sum(weight * np.bincount(row_of, values**2, n))) * 4 + penalty)
    w, b, w0, b0 = np.zeros(k), 0.0, np.zeros(k), 0.0
    for i in range(rounds):
        m = i / (i + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        z = np.bincount(row_of, values * u[ids], n) + c
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        w0, b0 = w, b
        w = u - step * (np.bincount(ids, values * g[row_of], k) + penalty * u)
        b = c - step * g.sum()
    return w, b


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, per_class: int = PER_CLASS, kept: int = KEPT, penalty: float = 1e-4, rounds: int = 1000) -> Model:
    """A model of ``labels`` (doc_id, toxic). ``trainable``: a condition on doc_id that rows to learn from must meet."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if trainable is not None:
        known = known.where(trainable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(per_class).unionAll(known.where("toxic = 0").orderBy(*order).limit(per_class))
    sample = cut(sample)  # at most 2 * per_class rows, so it may be broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(0)], pa.binary())], ["toxic", "ids"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        rows = [0, 0]
        for b in batches:
            for y, ids in zip(b.column(0).to_pylist(), b.column(1)):
                rows[y] += 1
                sums[y][np.frombuffer(ids.as_py(), np.int32)] += 1
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([rows[y]], pa.int64()), pa.array([sums[y].tobytes()], pa.binary())], ["toxic", "n", "sums"])

    found = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int")).mapInArrow(extract, "toxic int, ids binary"))
    p, n = np.ones((2, 1 << BITS)), [0, 0]
    for row in found.coalesce(6).mapInArrow(counted, "toxic int, n long, sums binary").toLocalIterator():
        p[row.toxic] += np.frombuffer(row.sums, np.int32)
        n[row.toxic] += row.n
    if not all(n):
        rate = n[1] / max(1, sum(n))
        return Model(np.zeros(1 << BITS), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    share = p / np.array([[n[0]], [n[1]]])
    pooled = p.sum(0) / sum(n)
    surely = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999999)) * (1 / n[0] + 1 / n[1]) + 1e-12)
    chosen = np.sort(np.argsort(-surely, kind="stable")[:kept]).astype(np.int32)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.searchsorted(chosen, np.intersect1d(np.frombuffer(ids.as_py(), np.int32), chosen, assume_unique=True)).astype(np.int32).tobytes() for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["toxic", "ids"])

    rows = [(r.toxic, np.frombuffer(r.ids, np.int32)) for r in found.mapInArrow(narrowed, "toxic int, ids binary").toLocalIterator()]
    rows.sort(key=lambda x: (x[0], x[1].tobytes()))  # partitions come in any order; the sums must not depend on it
    starts = np.cumsum([0] + [len(x) for _, x in rows[:-1]])
    value = ratio[chosen] / pooled[chosen] ** 0.25  # rare buckets are penalised less
    w, b = _regress(starts, np.concatenate([x for _, x in rows]), np.array([y for y, _ in rows]), value, penalty, rounds)
    weights = np.zeros(1 << BITS)
    weights[chosen] = w * value
    return Model(weights, min(float(b), NO_FEATURES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the chance of label 1. The model has a fixed size (8 MB) and travels with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.intercept))
    fields = docs.schema
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t.as_py()) for t in text], pa.float64())], names)

    return docs.mapInArrow(run, type(fields)([*fields.fields]).add("score", "double"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, by a model of the labels of their own documents."""
    model = fit(docs, labels)
    scored = score(docs.withColumnsRenamed({"score": "_score"}), model) if "score" in docs.columns else score(docs, model)
    return scored.where(F.col("score") < threshold).drop("score").withColumnsRenamed({"_score": "score"}).select(*docs.columns)
