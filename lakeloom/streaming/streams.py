"""Streams into materialized tables: append, changes, and append with late data and duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.changes import apply_changes
from lakeloom.operators.refresh import cast_to
from lakeloom.sources.store import Store


def file_stream(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic as a stream of keys and values (needs the Kafka connector)."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load()


def _per_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each batch as a version of the table.

    The version names its batch (by checkpoint and number), so one that is run again after a failure adds nothing.
    """
    return _per_batch(stream, checkpoint, lambda batch, number: store.append(batch, f"{checkpoint}#{number}") and None, once)


def changes_stream(stream: DataFrame, store: Store, table: T.StructType, key: list[str], checkpoint: str, sequence: str = "seq", once: bool = True) -> StreamingQuery:
    """Applies each batch of change rows; the offsets are committed after the version is.

    A batch that is run again gives the same table: the last change of a key wins.
    """

    def apply(batch: DataFrame, _: int) -> None:
        existing = store.read(table)
        if existing is None:
            existing = batch.sparkSession.createDataFrame([], table)
        store.overwrite(apply_changes(cast_to(existing, table), batch, key, sequence))

    return _per_batch(stream, checkpoint, apply, once)


def deduplicated(stream: DataFrame, time_column: str, overlap: str, key: list[str]) -> DataFrame:
    """Rows once by key, for duplicates that come within ``overlap`` of each other."""
    return stream.withWatermark(time_column, overlap).dropDuplicatesWithinWatermark(key)


def parquet_sink(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet folder, each batch exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
