"""A materialized table as Parquet versions with a pointer, so readers never see half a refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Versions of one table below a folder: each a folder of its own, named by a small pointer table.

    A version is written whole, then a pointer row is committed by Spark; readers
    resolve the latest pointer and keep their version. Works on any file system
    that Spark writes to.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version long, folders array<string>, rows long, updated_at timestamp, batch string").parquet(f"{self.path}/_pointers/*")
        except AnalysisException:
            return None

    def latest(self):
        pointers = self._pointers()
        return None if pointers is None else pointers.orderBy(F.col("version").desc()).first()

    def read(self, schema: T.StructType | None = None) -> DataFrame | None:
        """The current version, or None before the first."""
        now = self.latest()
        if now is None:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in now["folders"]])

    def has(self, batch: str) -> bool:
        """Whether a version was committed for this batch of a stream."""
        pointers = self._pointers()
        return pointers is not None and not pointers.where(F.col("batch") == batch).isEmpty()

    def _commit(self, folders: list[str], version: int, rows: int, batch: str | None) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.array(*map(F.lit, folders)).alias("folders"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("updated_at"), F.lit(batch).cast("string").alias("batch"))
        row.coalesce(1).write.parquet(f"{self.path}/_pointers/v{version:012d}")

    def _write(self, df: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def overwrite(self, df: DataFrame, batch: str | None = None) -> int:
        """A new version with these rows alone; returns their number."""
        now, folder = self.latest(), self._write(df)
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        self._commit([folder], (now["version"] if now else 0) + 1, n, batch)
        return n

    def append(self, df: DataFrame, batch: str | None = None) -> int:
        """A new version with these rows added; nothing old is rewritten. A named batch is added once, however often it is given."""
        if batch is not None and self.has(batch):
            return 0
        now = self.latest()
        if now is None:
            return self.overwrite(df, batch)
        folder = self._write(df)
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        self._commit([*now["folders"], folder], now["version"] + 1, now["rows"] + n, batch)
        return n
