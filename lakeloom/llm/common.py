"""Helpers that the training-data operators share: shared storage, exact ranks, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.sources.scratch import new_dir

#: ASCII white space, as the contracts define words: everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch, where the session has Spark's default.
BATCH_ROWS = 1000
#: Rows of one key that are numbered in one piece.
NUMBERED = 1 << 16


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Later jobs start from the written table, so nothing upstream runs twice and
    a lost executor costs no more than the tasks it was running.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` for rows that hold texts: batches of ``BATCH_ROWS`` rows, and tasks that give their memory back.

    Python workers outlive tasks and stages; what the allocators keep of a task's
    largest batch would add up. A session that has set another number of rows than
    Spark's default keeps it.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(rows) == "10000":
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    return df.mapInArrow(lean, schema)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path in it; works on driver and executors."""
    return pafs.FileSystem.from_uri(path)


#: How the names of files begin that a task is still writing.
TEMPORARY = "_temporary-"


def sweep(path: str) -> None:
    """Removes what lost or failed tasks have left in a folder whose manifest is committed."""
    fs, root = filesystem(path)
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(TEMPORARY):
            fs.delete_file(info.path)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the exact 0-based position of each row in ``order`` as a long.

    A range shuffle sorts, each partition counts, and the partitions' offsets
    (one small row each) are added back: no task sees more than its range.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(
        sorted_.withColumn("__pid", F.spark_partition_id()).withColumn(
            "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "ranked",
    )
    return (
        parts.join(F.broadcast(offsets(parts.groupBy("__pid").agg(F.count("*").alias("__n")), "__pid", "__n")), "__pid")
        .withColumn(name, F.col("__at") + F.col("__before"))
        .drop("__pid", "__at", "__before")
    )


def with_sums(df: DataFrame, order: Sequence[Column], amount: str, position: str, before: str) -> DataFrame:
    """Adds each row's exact position in ``order`` and the sum of ``amount`` over all rows before it.

    A range shuffle sorts, the tasks add up as they stream, and the partitions'
    offsets are added back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        pid, n, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            each = batch.column(amount).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(each) - each
            at = np.arange(n, n + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * batch.num_rows, pa.int32()), pa.array(at), pa.array(sums, pa.int64())], names=[*batch.schema.names, "__pid", position, before])
            n, total = n + batch.num_rows, total + int(each.sum())

    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField(position, T.LongType()), T.StructField(before, T.LongType())])
    parts = cut(map_batches(df.repartitionByRange(*order).sortWithinPartitions(*order), run, schema), "sums")
    of = parts.groupBy("__pid").agg(F.count("*").alias("n"), F.sum(amount).alias("s"))
    rows = F.broadcast(offsets(of, "__pid", "n").withColumnRenamed("__before", "__rows"))
    sums = F.broadcast(offsets(of, "__pid", "s").withColumnRenamed("__before", "__sums"))
    found = parts.join(rows, "__pid").join(sums, "__pid")
    return found.withColumn(position, F.col(position) + F.col("__rows")).withColumn(before, F.col(before) + F.col("__sums")).drop("__pid", "__rows", "__sums")


def numbered(rows: DataFrame, key: str, row: str, name: str) -> DataFrame:
    """Adds a long that tells rows of one ``key`` apart: 0, 1, 2 and so on.

    ``rows`` is a written table whose ``row`` differs in every row. Only keys that
    occur more than once are numbered, those of many rows in pieces of about
    ``NUMBERED`` rows, whose counts are summed up; no key meets in one task.
    """
    again = cut(rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1"), "again")
    if again.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    pieces = F.ceil(F.col("__n") / NUMBERED)
    mine = cut(rows.select(key, row).join(again, key).select(key, row, F.pmod(F.xxhash64(row), pieces).alias("__piece")), "repeated")
    each = mine.groupBy(key, "__piece").agg(F.count("*").alias("__n"))
    before = each.select(key, "__piece", (F.sum("__n").over(Window.partitionBy(key).orderBy("__piece")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(key, "__piece").orderBy(row)) - 1
    numbers = mine.withColumn("__nth", nth).join(before, [key, "__piece"]).select(row, (F.col("__before") + F.col("__nth")).alias(name))
    return rows.join(numbers, row, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """For one row per partition or file: ``key`` and ``__before``, the sum of ``n`` before it.

    The table has a row for each partition or file, not for each document, so
    the driver adds them up and the result may be broadcast.
    """
    before, rows = 0, []
    for r in counts.select(key, n).orderBy(key).toLocalIterator():
        rows.append((int(r[0]), before))
        before += int(r[1])
    return counts.sparkSession.createDataFrame(rows or [(-1, 0)], f"{key} int, __before long")


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def byte_parts(text: str, most: int = 1 << 19) -> Iterator[bytes]:
    """A text's bytes, A-Z lower-cased, in parts of about ``most`` characters that end where a word ends."""
    left = b""
    for k in range(0, len(text), most):
        data = left + text[k : k + most].encode().lower()
        left = b""
        if k + most < len(text) and not data[-1:].isspace():
            *head, left = data.rsplit(None, 1)
            data = data[: len(data) - len(left)] if head else b""
        if data:
            yield data


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` with about ``most`` bytes in ``column`` each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        floor = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, floor + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
