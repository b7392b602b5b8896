"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are reduced to words (A-Z lower-cased; ASCII digits and letters and all other
characters from U+0080 belong to words) joined by single spaces. Test strings are
all windows of ``WINDOW`` consecutive words of the benchmark items, each with a
space before and after it; a shorter item is one window. Blocks of up to eight
bytes index a shift table, so most positions of a text are never looked at; where
the shift is 0, the block selects a bucket of test strings, and comparing the bytes
confirms an occurrence. Many lanes of the text advance together in numpy.

The benchmark is dealt by Spark into parts of about ``PART_BYTES`` of text in the
shared folder, and each part is searched in a pass of its own, whose tasks read it
from there; so memory does not grow with the benchmark, and none of its texts
reaches the driver.

Defined cases: a null or empty text has no words and no hits; an item without words
has no window; items are told apart by item_id, a null item_id counts as the item
``null``; repeated rows count for themselves; of an empty table nothing is found, and
without items nothing is hit; columns of ``docs`` that clash with the result's are
replaced, others passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import cut, filesystem, map_batches, new_dir, slices, texts, with_sums

WINDOW = 10
PART_BYTES = 8 << 20
#: Test strings shorter than this are searched with tables of their own.
SHORT = 24
LANE = 512
TABLE_BITS = 20
#: What the search adds to its rows.
FOUND = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "items_sha256": "string", "contaminated": "boolean"}

_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_lower = np.full(256, 0x20, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _lower[_c] = _c
_lower[0x41:0x5B] = np.arange(0x61, 0x7B)


def windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The windows of an item, as the search looks for them."""
    words = _word.findall((text or "").encode().lower())
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def reduced(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as words between single spaces, a zero byte between texts, and each text's first byte."""
    raw = np.frombuffer(b" " + b" \x00 ".join([t.encode() for t in batch]) + b" ", np.uint8)
    ends = np.cumsum([0, *(len(t.encode()) + 3 for t in batch)])
    low = _lower[raw]
    low[ends[1:-1] - 1] = 0  # " text " and the zero byte
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20)
    begins = np.concatenate([[0], np.cumsum(keep)])[ends[:-1]]
    return low[keep], begins


class WuManber:
    """Shift and bucket tables for test strings of at least ``m`` bytes each."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        for end in range(b, m + 1):
            np.minimum.at(self.shift, self._hash(self._words(heads[:, end - b : end])), m - end)
        last = self._hash(self._words(heads[:, m - b : m]))
        self.order = np.argsort(last, kind="stable")
        self.buckets = last[self.order]
        self.prefix = self._words(heads[:, :b])

    @staticmethod
    def _words(blocks: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(blocks), 8), np.uint8)
        wide[:, : blocks.shape[1]] = blocks
        return wide.view("<u8").ravel()

    @staticmethod
    def _hash(words: np.ndarray) -> np.ndarray:
        return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """Start and pattern number of every occurrence in ``text``."""
        n, m, b = len(text), self.m, self.block
        if n < m:
            return
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.ndarray((n,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        at = np.arange(m, n + 1, LANE)  # ends of windows; a lane owns LANE of them
        stop = np.minimum(at + LANE, n + 1)
        found = []
        while len(at):
            h = self._hash(words[at - b] & self.mask)
            move = self.shift[h]
            zero = move == 0
            if zero.any():
                found.append((at[zero], h[zero]))
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return
        ends, h = (np.concatenate(x) for x in zip(*found))
        low = np.searchsorted(self.buckets, h, "left")
        count = np.searchsorted(self.buckets, h, "right") - low
        starts = np.repeat(ends - m, count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which = self.order[np.repeat(low, count) + nth]
        same = (words[starts] & self.mask) == self.prefix[which]
        data = text.tobytes()
        for s, k in zip(starts[same].tolist(), which[same].tolist()):
            if data.startswith(self.patterns[k], s):
                yield s, k


class Searcher:
    """One part of the benchmark, ready to be searched."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, window):
                owners.setdefault(w, set()).add(item)
        self.owners = owners
        classes = ([p for p in owners if len(p) >= SHORT], [p for p in owners if len(p) < SHORT])
        self.tables = [WuManber(sorted(c)) for c in classes if c]

    def search(self, batch: list[str]) -> list[tuple[int, set[int], set[str]]]:
        """Of each text: its number of words, the places of hit words, the items found."""
        text, begins = reduced(batch)
        is_start = np.zeros(len(text), bool)
        is_start[1:] = (text[:-1] == 0x20) & (text[1:] > 0x20)
        nth = np.cumsum(is_start)  # words that start up to here
        ends = np.append(begins[1:], len(text))
        before = np.where(begins > 0, nth[np.maximum(begins - 1, 0)], 0)
        n_words = nth[ends - 1] - before
        hits: dict[int, set[int]] = {}
        items: dict[int, set[str]] = {}
        for table in self.tables:
            for s, k in table.search(text):
                doc = int(np.searchsorted(begins, s, "right")) - 1
                pattern = table.patterns[k]
                first = int(nth[s + 1]) - 1 - int(before[doc])
                hits.setdefault(doc, set()).update(range(first, first + pattern.count(b" ") - 1))
                items.setdefault(doc, set()).update(self.owners[pattern])
        return [(int(n), hits.get(d, set()), items.get(d, set())) for d, n in enumerate(n_words)]


def parts_of(benchmark: DataFrame, item_id: str, text: str) -> list[str]:
    """Folders that hold the distinct items in parts of about ``PART_BYTES`` of text."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text")).distinct()
    sized = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    summed = with_sums(sized, [F.col("item"), F.col("text")], "size", "at", "before")
    path = new_dir(benchmark.sparkSession, "benchmark")
    dealt = summed.select("item", "text", F.floor(F.col("before") / PART_BYTES).alias("part"))
    dealt.repartition("part").write.partitionBy("part").parquet(path)
    schema = "item string, text string, part long"
    numbers = benchmark.sparkSession.read.schema(schema).parquet(path).select("part").distinct()
    return [f"{path}/part={k}" for k in sorted(r["part"] for r in numbers.collect())]


def _items(part: str | None) -> list[tuple[str, str | None]]:
    """The items in a part's folder; none if there is no part."""
    if part is None:
        return []
    import pyarrow.dataset as ds

    fs, root = filesystem(part)
    table = ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=["item", "text"])
    return list(zip(table.column("item").to_pylist(), table.column("text").to_pylist()))


def search_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` with what is found: n_words, n_hit, n_items, items, items_sha256, contaminated.

    Columns of ``docs`` with these names are replaced. ``items_sha256`` is of the
    found items' ids, sorted as strings and comma-joined.
    """
    base = docs.drop(*FOUND)
    schema = T.StructType([*base.schema.fields, T.StructField("__hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())])
    parts = parts_of(benchmark, item_id, item_text)
    found = base.withColumn("__hits", F.array().cast("array<int>")).withColumn("items", F.array().cast("array<string>")).withColumn("n_words", F.lit(0).cast("long"))
    for k, part in enumerate(parts or [None]):
        found = map_batches(found, _pass(part, window, text), schema)
        if k < len(parts) - 1:
            found = cut(found, "searched")
    return (
        found.withColumn("n_hit", F.size("__hits").cast("long"))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select(*base.columns, *FOUND)
    )


_searchers: dict[tuple[str | None, int], Searcher] = {}


def _pass(part: str | None, window: int, text: str):
    mark = (part, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _searchers:
            _searchers.clear()
            _searchers[mark] = Searcher(_items(part), window)
        searcher = _searchers[mark]
        for batch in batches:
            for piece in slices(batch, text):
                found = searcher.search(texts(piece.column(text)))
                hits = [sorted({*old, *new}) for old, (_, new, _) in zip(piece.column("__hits").to_pylist(), found)]
                items = [sorted({*old, *new}) for old, (_, _, new) in zip(piece.column("items").to_pylist(), found)]
                names = piece.schema.names
                made = {"__hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array([n for n, _, _ in found], pa.int64())}
                yield pa.RecordBatch.from_arrays([made.get(c, piece.column(k)) for k, c in enumerate(names)], names=names)

    return run
