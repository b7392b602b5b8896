"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A document's fingerprint has a bit for each of 64: set if over half of its shingles'
XXH64 values have it. Equal fingerprints are one entry. Two fingerprints of at most
``MOST_BITS`` = 3 differing bits share at least 8 - 3 = 5 of their eight positional
bytes, so they meet in the posting list of the first three positions that they
share: these lie among the first six. Lists are keyed by three positions and their
bytes (20 lists a fingerprint). In a list the shared positional bytes of each pair
are tallied, pairs with five or more are kept, and the differing bits are counted;
a pair counts only in the list of its first three shared positions.

Lists of more than ``HOT`` fingerprints (groups of near copies, or very many
documents) are refined to five of eight positions. Those still longer are dealt in
blocks: a task tallies the shared bytes between two blocks, verifies the pairs that
reach the minimum and returns the links of a spanning forest, never all pairs. Links thus give the exact components; nothing is capped or dropped.

Defined cases: a null text is empty; a text without words has fingerprint zero and
is linked like any other; repeated rows are kept; a null doc_id never names a
component unless all its documents lack ids; other columns are ignored; a very long
text is hashed in parts; an empty table is fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import byte_parts, cut, map_batches, slices, texts
from lakeloom.llm.components import components

SHINGLE = 3
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
HOT = 64
BLOCK = 1024


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words; of all of them if there are fewer."""
    from xxhash import xxh64_intdigest

    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    view = memoryview(b" ".join(words))
    return np.fromiter((xxh64_intdigest(view[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned; a long text is hashed part by part."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for data in byte_parts(text or ""):
        words += data.split()
        if len(words) >= shingle:
            hashes = _hashes(words, shingle)
            for k in range(0, len(hashes), 1 << 14):
                ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n, words = n + len(hashes), words[len(words) - shingle + 1 :]
    if not n and words:
        return int(_hashes(words, shingle)[0])
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; then the long columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = np.array([fingerprint(t, shingle) for t in texts(piece.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found.view(np.int64)), *(piece.column(c) for c in keep)], names=["doc_id", "fp", *keep])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    return map_batches(rows, run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in keep)]))


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))


def _postings(fps: DataFrame, size: int, within: int) -> DataFrame:
    """(key, fp): the entry of each fingerprint in each list of ``size`` of the first ``within`` positions.

    A key holds the list's number above the bytes at its positions.
    """
    keys = []
    for number, positions in enumerate(combinations(range(within), size)):
        key = F.lit(number).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), p))
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _pairs(postings: DataFrame, size: int, within: int) -> DataFrame:
    """(u, v): pairs of a list with at most MOST_BITS differing bits, each in one list only.

    The shared positional bytes of a pair are a bit set; the pair counts in the
    list of its first ``size`` shared positions, and only with LEAST_BYTES of them.
    """
    chosen = list(combinations(range(within), size))
    of = F.shiftright("key", 8 * size).cast("int") + 1
    own = F.element_at(F.array(*[F.lit(sum(1 << p for p in c)) for c in chosen]), of)
    upto = F.element_at(F.array(*[F.lit((2 << c[-1]) - 1) for c in chosen]), of)
    other = F.col("other")
    shared = sum((F.when(_byte(F.col("fp"), p) == _byte(other, p), 1 << p).otherwise(0) for p in range(8)), F.lit(0))
    kept = (F.col("fp") < other) & (shared.bitwiseAND(upto) == own) & (F.bit_count(shared) >= LEAST_BYTES)
    near = F.bit_count(F.col("fp").bitwiseXOR(other)) <= MOST_BITS
    theirs = postings.select("key", F.col("fp").alias("other"))
    return postings.join(theirs, "key").where(kept & near).select(F.col("fp").alias("u"), other.alias("v"))


def _shared_bytes(differing: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are zero, that is, shared."""
    return (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _forest(fps: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of at most MOST_BITS connect, within fps or between both."""
    nodes = fps if other is None else np.concatenate([fps, other])
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(fps)):
        rest, base = (fps[i + 1 :], i + 1) if other is None else (other, len(fps))
        shared = np.flatnonzero(_shared_bytes(rest ^ fps[i]) >= LEAST_BYTES)
        for j in (shared[np.bitwise_count(rest[shared] ^ fps[i]) <= MOST_BITS] + base).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((nodes[i], nodes[j]))
    pairs = np.array(links, np.uint64).reshape(-1, 2)
    return pairs[:, 0].view(np.int64), pairs[:, 1].view(np.int64)


def _compare(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Two blocks of a list, or one with itself: the links of a spanning forest."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    side = table.column("side").to_numpy()
    u, v = _forest(fp) if keys[1] == keys[2] else _forest(fp[side == 0], fp[side == 1])
    return pa.table({"u": u, "v": v})


def _blocks(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """(u, v): links inside hot lists, compared block by block."""
    n = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = postings.join(hot, "key").withColumn("n", n).withColumn("b", F.pmod(F.xxhash64("fp", "key"), F.col("n")).cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), (F.col("b") > o).cast("int").alias("side")))
    blocks = dealt.select("key", "fp", F.explode(with_each).alias("p")).select("key", "p.i", "p.j", "p.side", "fp")
    return blocks.groupBy("key", "i", "j").applyInArrow(_compare, "u long, v long")


def _hot(postings: DataFrame, name: str) -> DataFrame:
    return cut(postings.groupBy("key").count().where(F.col("count") > HOT), name)


def links(fps: DataFrame) -> DataFrame:
    """(u, v) over distinct fingerprints: enough links to give the exact components."""
    postings = _postings(fps, 3, 6)
    hot = _hot(postings, "hot")
    near = _pairs(postings.join(hot, "key", "left_anti"), 3, 6)
    if hot.isEmpty():
        return near
    crowded = cut(postings.join(hot, "key", "left_semi").select("fp").distinct(), "crowded")
    finer = _postings(crowded, LEAST_BYTES, 8)
    dense = _hot(finer, "dense")
    near = near.unionByName(_pairs(finer.join(dense, "key", "left_anti"), LEAST_BYTES, 8))
    return near if dense.isEmpty() else near.unionByName(_blocks(finer, dense))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, the least id of its group."""
    found = cut(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(classes.select("fp"))).withColumnsRenamed({"node": "fp", "root": "__root"})
    labelled = classes.join(roots, "fp", "left").withColumn("__root", F.coalesce("__root", "fp"))
    least = labelled.groupBy("__root").agg(F.min("rep").alias("component_id"))
    named = cut(labelled.join(least, "__root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each group: the one with the least id (null last), then hash of its text, then place.

    Rows are told apart by a number that is written with them, so repeated rows,
    shared ids and null ids are rows like any other.
    """
    keyed = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    hashed = keyed.withColumn("__text", F.xxhash64(F.col(text).cast("string")))
    found = cut(fingerprints(hashed, shingle, doc_id, text, ("__text", "__row")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text", "__row")
    classes = cut(found.groupBy("fp").agg(F.min(order).alias("best")), "classes")
    roots = components(links(classes.select("fp"))).withColumnsRenamed({"node": "fp", "root": "__root"})
    labelled = classes.join(roots, "fp", "left").withColumn("__root", F.coalesce("__root", "fp"))
    kept = labelled.groupBy("__root").agg(F.min("best").alias("best")).select("best.__row")
    return keyed.join(kept, "__row", "left_semi").select(*docs.columns)
