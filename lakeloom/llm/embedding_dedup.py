"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Vectors of one label are compared by cosine. Equal vectors are one class with a
count. Each class is rotated (random signs and a fast Hadamard transform, three
times) for every hash of every table; a hash is the axis with the largest value and
its sign. A table joins the hashes of one rotation each into a bucket, and the
``PROBES`` next best axes give further buckets (multiprobe). Classes that meet in a
bucket are candidates, and links are those whose cosine, computed in double
precision, reaches the threshold. A bucket's number has as many bits as keep the
chance candidates of a vector at ``CHANCE`` whatever the largest label's classes are:
hashes are added as they grow in number, the last one in part, and tables with them.

Buckets of at most ``HOT`` classes give candidate pairs, each verified once. Larger
ones (groups of near copies) are dealt in blocks; a task compares two blocks and
returns each class's number of links and a spanning forest, never all pairs, and a
pair counts in the first of the large buckets that it shares.

Defined cases: vectors that are null, zero, or hold null or non-finite components,
null labels and null ids link with nothing; vectors of different lengths are not
compared; repeated rows are vectors of their own; a row without an id has no
component and isn't kept; components are compared as given (floats, or else doubles);
other columns are ignored; an empty table is fine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import cut, map_batches
from lakeloom.llm.components import components

THRESHOLD = 0.93
PROBES = 3
#: Candidates of a vector that meet by chance, about.
CHANCE = 2
HOT = 128
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of ``x`` (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def shape(classes: int, d: int) -> tuple[int, int]:
    """Tables, and bits of a bucket's number, for so many classes of one label.

    A pair at the threshold shares a table's bucket with a probability that falls
    with its number of hashes (about 0.85, 0.62, 0.41, 0.25 for two to five); so many
    tables miss one such pair in about a thousand.
    """
    width, hashes = _full(d).bit_length(), 1
    while True:
        tables = math.ceil(5 * 1.75 ** (hashes - 2))
        bits = max(1, math.ceil(math.log2(tables * (1 + PROBES) ** 2 * classes / CHANCE)))
        if bits <= width * hashes:
            return tables, bits
        hashes += 1


def _full(d: int) -> int:
    """The power of two that a vector is filled up to."""
    return 1 << max(1, (d - 1).bit_length())


def bucket_keys(x: np.ndarray, tables: int, bits: int, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """(rows, tables * (1 + probes)) bucket numbers, of ``bits`` bits, of unit vectors."""
    n, d = x.shape
    full = _full(d)
    width = full.bit_length()  # bits of a hash: axis and sign
    hashes = -(-bits // width)
    last = (1 << (bits - width * (hashes - 1))) - 1
    padded = np.zeros((n, full))
    padded[:, :d] = x
    rng = np.random.default_rng((seed, full))
    keys = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        codes, losses, seconds = [], [], []
        for h in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), full)) / math.sqrt(full)
            near = np.argpartition(-np.abs(y), min(1 + probes, full - 1), axis=1)[:, : 1 + probes]
            size = np.abs(np.take_along_axis(y, near, 1))
            order = np.argsort(-size, axis=1, kind="stable")
            near, size = np.take_along_axis(near, order, 1), np.take_along_axis(size, order, 1)
            code = near * 2 + (np.take_along_axis(y, near, 1) < 0)
            if h == hashes - 1:
                code &= last
            codes.append(code[:, 0])
            seconds.append(code[:, 1:])
            losses.append(size[:, :1] ** 2 - size[:, 1:] ** 2)
        base = np.zeros(n, np.int64)
        for c in codes:
            base = base * (2 * full) + c
        keys[:, t, 0] = base
        loss = np.concatenate(losses, axis=1)  # of changing one hash to its k-th best axis
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        for p in range(best.shape[1]):
            which, k = best[:, p] // losses[0].shape[1], best[:, p] % losses[0].shape[1]
            code = np.stack(codes)[which, rows]
            other = np.stack(seconds)[which, rows, k]
            weight = (2 * full) ** (hashes - 1 - which)
            keys[:, t, 1 + p] = base + (other - code) * weight
    return keys.reshape(n, -1)


def _buckets(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """(cls, label, t, key): the buckets of each class; t tells tables and lengths of vectors apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            lengths = np.array([len(v) for v in vectors])
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = np.array([vectors[k] for k in at], np.float64)
                keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, bits)
                m = keys.shape[1]
                rows = pa.array(np.repeat(at, m))
                t = np.tile(np.repeat(np.arange(tables) + tables * d, m // tables), len(at)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("cls").take(rows), batch.column("label").take(rows), pa.array(t), pa.array(keys.ravel())], names=["cls", "label", "t", "key"])

    schema = f"cls long, label {classes.schema['label'].dataType.simpleString()}, t int, key long"
    return map_batches(classes.select("cls", "label", "embedding"), run, schema)


def _forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the pairs (rows of two places), those that join what was not yet joined."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in links.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def _compare(threshold: float):
    def compare(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Two blocks of a large bucket: numbers of links by class (v null) and a forest (n null)."""
        bucket, within = keys[0].as_py(), keys[1] == keys[2]
        x = np.array(table.column("embedding").to_pylist(), np.float64).reshape(table.num_rows, -1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cls, count, side = (table.column(c).to_numpy() for c in ("cls", "n", "side"))
        earlier: dict[int, list[int]] = {}
        for k, all_ in enumerate(table.column("hot").to_pylist()):
            for b in all_:
                if b < bucket:
                    earlier.setdefault(b, []).append(k)
        first, second = (np.arange(len(cls)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        linked = x[first] @ x[second].T >= threshold
        if earlier:
            member = np.zeros((len(cls), len(earlier)), np.float32)
            for j, at in enumerate(earlier.values()):
                member[at, j] = 1
            linked &= ~(member[first] @ member[second].T > 0)
        if within:
            np.fill_diagonal(linked, False)
        total = np.zeros(len(cls), np.int64)
        np.add.at(total, first, linked @ count[second])
        if not within:
            np.add.at(total, second, count[first] @ linked)
        at = np.flatnonzero(total)
        pairs = np.argwhere(np.triu(linked) if within else linked)
        pairs = np.array(_forest(np.stack([first[pairs[:, 0]], second[pairs[:, 1]]], axis=1), len(cls)), np.int64).reshape(-1, 2)
        u = np.concatenate([cls[at], cls[pairs[:, 0]]])
        v = pa.array([None] * len(at) + cls[pairs[:, 1]].tolist(), pa.int64())
        return pa.table({"u": pa.array(u), "v": v, "n": pa.array(total[at].tolist() + [None] * len(pairs), pa.int64())})

    return compare


def _dot(a: str, b: str):
    each = F.zip_with(F.col(a), F.col(b), lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(each, F.lit(0.0), lambda total, p: total + p)


def _norm(a: str):
    return F.sqrt(F.aggregate(F.col(a), F.lit(0.0), lambda total, p: total + p.cast("double") * p.cast("double")))


def _pairs(classes: DataFrame, buckets: DataFrame, hot: DataFrame | None, threshold: float) -> DataFrame:
    """(u, v): linked classes that share no large bucket, each pair once."""
    mine = buckets
    vectors = classes.select("cls", "embedding", _norm("embedding").alias("norm"))
    if hot is not None:
        mine = mine.join(hot, ["label", "t", "key"], "left_anti")
        own = buckets.join(hot, ["label", "t", "key"]).groupBy("cls").agg(F.collect_set("bucket").alias("hot"))
        vectors = vectors.join(own, "cls", "left")
    theirs = mine.select("label", "t", "key", F.col("cls").alias("v"))
    found = mine.withColumnRenamed("cls", "u").join(theirs, ["label", "t", "key"]).where("u < v").select("u", "v").distinct()
    left = vectors.withColumnsRenamed({c: f"{c}1" for c in vectors.columns})
    right = vectors.withColumnsRenamed({c: f"{c}2" for c in vectors.columns})
    both = found.join(left, F.col("u") == F.col("cls1")).join(right, F.col("v") == F.col("cls2"))
    linked = _dot("embedding1", "embedding2") / (F.col("norm1") * F.col("norm2")) >= threshold
    if hot is not None:
        linked &= ~F.coalesce(F.arrays_overlap("hot1", "hot2"), F.lit(False))
    return both.where(linked).select("u", "v")


def _large(classes: DataFrame, buckets: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """Of large buckets, block by block: numbers of links by class, and forests."""
    member = cut(buckets.join(hot, ["label", "t", "key"]).select("cls", "bucket", "size").distinct(), "member")
    own = member.groupBy("cls").agg(F.collect_set("bucket").alias("hot"))
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = member.withColumn("blocks", n).withColumn("b", F.pmod(F.xxhash64("cls", "bucket"), F.col("blocks")).cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), (F.col("b") > o).cast("int").alias("side")))
    placed = dealt.select("cls", "bucket", F.explode(with_each).alias("p")).select("cls", "bucket", "p.i", "p.j", "p.side")
    rows = placed.join(own, "cls").join(classes.select("cls", "n", "embedding"), "cls")
    return rows.groupBy("bucket", "i", "j").applyInArrow(_compare(threshold), "u long, v long, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept."""
    kind = "array<float>" if vectors.schema[embedding].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite, F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    if not most["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    buckets = cut(_buckets(classes, *shape(most["n"], most["d"])), "buckets")
    hot = buckets.groupBy("label", "t", "key").agg(F.count("*").alias("size")).where(F.col("size") > HOT)
    hot = cut(hot.withColumn("bucket", F.monotonically_increasing_id()), "hot")
    any_hot = not hot.isEmpty()
    links = cut(_pairs(classes, buckets, hot if any_hot else None, threshold), "links")
    edges = links
    sums = links.join(classes.select(F.col("cls").alias("v"), "n"), "v").select(F.col("u").alias("cls"), "n")
    sums = sums.unionByName(links.join(classes.select(F.col("cls").alias("u"), "n"), "u").select(F.col("v").alias("cls"), "n"))
    if any_hot:
        large = cut(_large(classes, buckets, hot, threshold), "large")
        edges = edges.unionByName(large.where("v IS NOT NULL").select("u", "v"))
        sums = sums.unionByName(large.where("v IS NULL").select(F.col("u").alias("cls"), "n"))
    roots = components(edges).withColumnsRenamed({"node": "cls", "root": "root"})
    labelled = classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = classes.join(labelled.select("cls", "root"), "cls").join(least, "root").join(sums.groupBy("cls").agg(F.sum("n").alias("others")), "cls", "left")
    found = cut(found.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "found")
    joined = rows.where("usable").join(found, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
