"""Embedding columns, chunks, and vector search."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.vectors import cosine_distance, vector

Embedder = Callable[[pd.Series], list[list[float]]]
DEFAULT_LIMIT = 3
#: Rows of an Arrow batch of texts to embed, where the session has Spark's default.
BATCH_ROWS = 1000
#: Texts or chunks that an embedder gets at a time.
PIECES = 512
_BREAKS = ("\n\n", "\n", ". ", " ")
#: Before headings and code first; what begins with a line's end is cut after it.
_MARKDOWN_BREAKS = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n```", *_BREAKS)


def hash_embedder(dimensions: int = 64) -> Embedder:
    """A deterministic embedder without a model: hashed words, signed and summed."""

    def embed(texts: pd.Series) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
            out.append(v)
        return out

    return embed


def token_sizer(vocabulary: str) -> Callable[[str], int]:
    """Sizes in tokens of a tokenizer file (needs the tokenizers library); the file is opened by each task."""
    opened: list = []

    def size(text: str) -> int:
        if not opened:
            from tokenizers import Tokenizer

            opened.append(Tokenizer.from_file(vocabulary))
        return len(opened[0].encode(text, add_special_tokens=False).ids)

    return size


def chunk_bounds(text: str, target: int, overlap: int = 0, trim: bool = True, markdown: bool = False, size: Callable[[str], int] = len) -> list[tuple[int, int]]:
    """Places of chunks of at most ``target`` (in characters, or as ``size`` measures), cut at the largest break that fits."""
    bounds, start = [], 0
    while start < len(text):
        end = min(len(text), start + target)
        if size is not len:  # the longest piece that fits, if pieces only grow with their length
            low, high = start + 1, len(text)
            while low < high:
                middle = (low + high + 1) // 2 if high < low + 16 * target else low + 8 * target
                low, high = (middle, high) if size(text[start:middle]) <= target else (low, middle - 1)
            end = low
        if end < len(text):
            for mark in _MARKDOWN_BREAKS if markdown else _BREAKS:
                at = text.rfind(mark, start + 1, end)
                if at > start:
                    end = at + (1 if mark[1:2] in ("#", "`") else len(mark))
                    break
        piece = text[start:end]
        a = start + len(piece) - len(piece.lstrip()) if trim else start
        b = a + len(piece.strip()) if trim else end
        if b > a:
            bounds.append((a, b))
        start = max(end - overlap, start + 1) if end < len(text) else end
    return bounds


def embed_column(df: DataFrame, column: str, embedder: Embedder, target_chunk: int | None = None, overlap: int = 0, markdown: bool = False, size: Callable[[str], int] = len) -> DataFrame:
    """Adds ``<column>_embedding``, and with chunks ``<column>_offset`` (start and end of each chunk, in characters).

    A column of that name in the base table is kept. Spark leaves the work out
    where neither column is used. The embedder gets ``PIECES`` texts at a time, and only
    their vectors are Python numbers; those of a batch of ``BATCH_ROWS`` rows are kept in Arrow.
    """
    name = f"{column}_embedding"
    if name in df.columns:
        return df
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(rows) == "10000":
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    if target_chunk is None:
        one = F.arrow_udf(_plain(embedder), T.ArrayType(T.FloatType()))
        return df.withColumn(name, one(F.col(column)))
    kind = T.StructType([T.StructField("embedding", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("offset", T.ArrayType(T.ArrayType(T.IntegerType())))])
    many = F.arrow_udf(_chunked(embedder, lambda t: chunk_bounds(t, target_chunk, overlap, markdown=markdown, size=size)), kind)
    return df.withColumn("__made", many(F.col(column))).withColumn(name, F.col("__made.embedding")).withColumn(f"{column}_offset", F.col("__made.offset")).drop("__made")


def _vectors(embedder: Embedder, pieces: Iterator[str | None]) -> pa.Array:
    kind, parts = pa.list_(pa.float32()), []
    while some := list(islice(pieces, PIECES)):
        parts.append(pa.array(list(embedder(pd.Series(some, dtype=object))), kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _plain(embedder: Embedder):
    def run(texts: pa.Array) -> pa.Array:
        return _vectors(embedder, (t.as_py() for t in texts))

    return run


def _chunked(embedder: Embedder, split: Callable[[str], list[tuple[int, int]]]):
    def run(texts: pa.Array) -> pa.Array:
        counts, places = array("i", [0]), array("i")

        def pieces() -> Iterator[str]:
            for t in texts:
                text = t.as_py() or ""
                bounds = split(text)
                counts.append(len(bounds))
                for a, b in bounds:
                    places.extend((a, b))
                    yield text[a:b]

        vectors = _vectors(embedder, pieces())
        rows = pa.array(np.cumsum(counts, dtype=np.int32))
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(places) + 1, 2, dtype=np.int32)), pa.array(np.array(places, np.int32)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(rows, vectors), pa.ListArray.from_arrays(rows, pairs)], names=["embedding", "offset"])

    return run


def embedding_kind(schema: T.StructType, column: str) -> str | None:
    """``plain`` or ``chunked`` if the table has valid embedding columns for ``column``, else None."""
    by_name = {f.name: f.dataType for f in schema.fields}
    kind = by_name.get(f"{column}_embedding")
    number = lambda t: isinstance(t, (T.FloatType, T.DoubleType))
    if not isinstance(kind, T.ArrayType):
        return None
    if number(kind.elementType):
        return "plain"
    nested = isinstance(kind.elementType, T.ArrayType) and number(kind.elementType.elementType)
    offset = by_name.get(f"{column}_offset")
    whole = isinstance(offset, T.ArrayType) and isinstance(offset.elementType, T.ArrayType) and isinstance(offset.elementType.elementType, T.IntegralType)
    return "chunked" if nested and whole else None


@dataclass
class SearchRequest:
    """What to search: a query vector (or a text, for an embedder), filter, further columns and the number of matches."""

    query: list[float] | str
    limit: int = DEFAULT_LIMIT
    where: str | Column | None = None
    additional_columns: list[str] = field(default_factory=list)


def vector_search(df: DataFrame, column: str, key: list[str], request: SearchRequest, dataset: str = "") -> DataFrame:
    """The best matches: value, score (1 - distance), dataset, primary_key and metadata.

    The top-k keeps ``limit`` rows of each task. With chunks, a key's best chunk counts and is cut out of the text.
    """
    name, kind = f"{column}_embedding", embedding_kind(df.schema, column)
    if kind is None:
        raise ValueError(f"{column} has no embedding")
    if request.where is not None:
        df = df.where(request.where)
    query = vector(request.query)
    order = [F.col("dist").asc_nulls_last(), *[F.col(k) for k in key]]
    finite = lambda d: d.where("dist IS NOT NULL AND NOT isnan(dist)")
    if kind == "plain":
        best = finite(df.withColumn("dist", cosine_distance(F.col(name), query))).orderBy(*order).limit(request.limit).withColumn("value", F.col(column))
    else:
        chunks = F.arrays_zip(F.col(name).alias("e"), F.col(f"{column}_offset").alias("o"))
        nearest = F.array_min(F.transform(chunks, lambda c: F.struct(cosine_distance(c["e"], query).alias("dist"), c["o"].alias("offset"))))
        found = finite(df.withColumn("__best", nearest).withColumn("dist", F.col("__best.dist"))).orderBy(*order).limit(request.limit)
        start, end = F.element_at("__best.offset", 1), F.element_at("__best.offset", 2)
        best = found.withColumn("value", F.substr(F.col(column), start + 1, end - start))
    more = [c for c in request.additional_columns if c not in key]
    metadata = F.struct(*[F.col(c) for c in more]) if more else F.struct(F.lit(None).cast("string").alias("none"))
    return best.select("value", (1 - F.col("dist")).alias("score"), F.lit(dataset).alias("dataset"), F.struct(*key).alias("primary_key"), metadata.alias("metadata"))


def search_datasets(datasets: dict[str, tuple[DataFrame, str, list[str]]], request: SearchRequest, embedder: Embedder | None = None) -> DataFrame:
    """The best matches over several datasets, named with their table, text column and key; keys and further columns are JSON.

    A text to search for is embedded as the datasets' texts were. Each dataset gives its
    own ``limit`` matches, so only few rows are compared in the end.
    """
    if isinstance(request.query, str):
        request = replace(request, query=[float(x) for x in embedder(pd.Series([request.query]))[0]])
    found = None
    for name, (df, column, key) in datasets.items():
        if embedding_kind(df.schema, column) is None:
            df = embed_column(df, column, embedder)
        own = replace(request, additional_columns=[c for c in request.additional_columns if c in df.columns])
        best = vector_search(df, column, key, own, name).select("value", "score", "dataset", F.to_json("primary_key").alias("primary_key"), F.to_json("metadata").alias("metadata"))
        found = best if found is None else found.unionByName(best)
    return found.orderBy(F.col("score").desc(), "dataset", "primary_key").limit(request.limit)


def predict(df: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, time_column: str = "ts") -> DataFrame:
    """Runs a model over batches of the rows, each task's in order of time."""
    return df.repartitionByRange(time_column).sortWithinPartitions(time_column).mapInPandas(model, schema)
