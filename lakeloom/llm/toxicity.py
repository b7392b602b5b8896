"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams of ``SIZES`` characters that
its lower-cased text holds, whatever their number. From labelled texts, each
feature's log-count ratio r = log (share in class 1 / share in class 0), smoothed,
scales it; logistic regression over the scaled features gives the weights. Training
uses at most ``MOST_PER_CLASS`` labelled rows of each class, those with the least
hashes of their ids, and the ``FEATURES`` features with the largest evidence; the
intercept is then moved to the classes' shares among all labelled rows.

Defined cases: a null text is empty and gets the intercept's score; null labels and
labels of unknown documents teach nothing; of repeated labels of a document the
largest counts, and of several texts of a labelled id that with the least hash; a very
long text is hashed in parts; other columns are passed on; with one class only, every score is that class's share; an empty
labels table gives score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import cut, held_out, map_batches, slices, texts

SIZES = (3, 4, 5, 6)
BITS = 20
#: Characters of a text whose n-grams are in memory at a time.
PART = 1 << 19
MOST_PER_CLASS = 3000
FEATURES = 1 << 13
THRESHOLD = 0.3
ADDED = {"score": T.DoubleType(), "predicted": T.IntegerType()}


def hashes(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, repeats included, by size and part of the text."""
    padded, longest = f" {text.lower()} ", SIZES[-1]
    for k in range(0, len(padded), PART):
        chars = np.frombuffer(padded[k : k + PART + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = chars
        for n in range(2, longest + 1):
            if len(chars) < n:
                break
            h = h[: len(chars) - n + 1] * np.uint32(0x01000193) ^ chars[n - 1 :] * np.uint32(0x85EBCA6B)
            if n in SIZES:
                yield (h[:PART] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def features(text: str, chosen: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text for which ``chosen`` (by hash) holds."""
    found = [h[chosen[h]] for h in hashes(text)] if len(text) < PART else [np.unique(h[chosen[h]]) for h in hashes(text)]
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *found]))


@dataclass
class Model:
    """Weights of the hashed features and an intercept."""

    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.chosen = self.weights != 0

    def score(self, text: str) -> float:
        if np.isinf(self.intercept):
            return float(self.intercept > 0)
        z = self.intercept + float(self.weights[features(text, self.chosen)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, l2: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression over present features times their ratio, by accelerated gradient descent.

    ``rows`` hold each document's places in ``ratio``. Returns weights (times
    the ratios) and the intercept.
    """
    flat = np.concatenate(rows).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale, n, k = ratio[flat], len(rows), len(ratio)
    times = lambda w: np.bincount(doc, scale * w[flat], n)
    back = lambda g: np.bincount(flat, scale * g[doc], k)
    x = np.ones(k)
    for _ in range(8):  # the largest singular value, for the step size
        x /= np.linalg.norm(x) + 1e-12
        x = back(times(x))
    step = 1 / (0.25 * (np.linalg.norm(x) + n) + l2)
    w = v = np.zeros(k)
    b = c = 0.0
    for t in range(steps):
        g = 1 / (1 + np.exp(-np.clip(times(v) + c, -50, 50))) - labels
        w2, b2 = v - step * (back(g) + l2 * v), c - step * g.sum()
        m = t / (t + 3)
        v, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", most_per_class: int = MOST_PER_CLASS, l2: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from ``labels`` (doc_id, target 0 or 1) outside the held-out fold."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(most_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts_of = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = cut(texts_of, "labelled")
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    of = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(of) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float("inf") if 1 in of else float("-inf"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        every = np.ones(1 << BITS, bool)
        for batch in batches:
            for t, y in zip(texts(batch.column("text")), batch.column("y").to_pylist()):
                seen[y, features(t, every)] += 1
        f = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(seen[0, f]), pa.array(seen[1, f])], names=["f", "n0", "n1"])

    counts = map_batches(sample, count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    s0, s1 = (F.col("n0") + 1) / (of[0] + 2), (F.col("n1") + 1) / (of[1] + 2)
    ratio = F.log(s1 / s0)
    best = counts.where("n0 + n1 > 2").select("f", ratio.alias("r")).orderBy(F.abs((s1 - s0) * ratio).desc(), "f").limit(FEATURES).collect()
    chosen, place = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)
    ids = np.array([b["f"] for b in best], np.int64)
    chosen[ids], place[ids] = True, np.arange(len(ids))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place[features(t, chosen)] for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x.tobytes() for x in found], pa.binary())], names=["y", "x"])

    got = map_batches(sample, reduce, "y int, x binary").collect()
    weights, b = fit([np.frombuffer(r["x"], np.int32) for r in got], np.array([r["y"] for r in got], float), np.array([r["r"] for r in best]), l2)
    full = np.zeros(1 << BITS, np.float32)
    full[ids] = weights
    return Model(full, b + np.log(share[1] / share[0]) - np.log(of[1] / of[0]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows and columns of ``docs`` with score and predicted (1 from ``threshold`` on), replacing such columns."""
    base = docs.drop(*ADDED)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                scores = pa.array([model.score(t) for t in texts(piece.column(text))], pa.float64())
                yield pa.RecordBatch.from_arrays([*piece.columns, scores], names=[*piece.schema.names, "score"])

    return map_batches(base, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
