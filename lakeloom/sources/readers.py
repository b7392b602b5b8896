"""Sources as Spark readers: files in several formats, listings, JDBC, nested objects, paged JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = {"parquet": "parquet", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "txt": "text", "md": "text"}


def format_of(path: str, given: str | None = None) -> str:
    """The format given, or the one of the path's extension; an error if neither says."""
    suffix = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    found = given or SUFFIXES.get(suffix)
    if found is None:
        raise ValueError(f"{path} has no known extension; say its file_format")
    return found


def read_files(spark: SparkSession, path: str, file_format: str | None = None, hive_partitions: bool = False, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A table over files (local, s3a, abfss, ftp, sftp: whatever Hadoop can open).

    CSV has a header, ``"`` quotes and an inferred schema unless options differ; with
    ``hive_partitions`` folders ``key=value`` become text columns, else they are
    ignored and all folders are read. Text gives one row per file.
    """
    kind = format_of(path, file_format)
    reader = spark.read.options(recursiveFileLookup=str(not hive_partitions).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        settings = {"header": "true", "quote": '"', "sep": "\t" if kind == "tsv" else ",", "inferSchema": str(schema is None).lower()}
        return reader.options(**settings | options).csv(path)
    if kind == "text":
        return documents(spark, path)
    df = reader.options(**options).format(kind).load(path)
    if hive_partitions and kind == "parquet":
        df = _partitions_as_text(df, path)
    return df


def _partitions_as_text(df: DataFrame, path: str) -> DataFrame:
    """Partition columns are typed as text whatever their values look like."""
    names = [k for k in df.columns if k not in _file_columns(df, path)]
    return df.withColumns({k: F.col(k).cast("string") for k in names}) if names else df


def _file_columns(df: DataFrame, path: str) -> list[str]:
    return df.sparkSession.read.option("recursiveFileLookup", "true").parquet(path).columns


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: location and content."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("location"), F.col("value").alias("content"))


def parsed_documents(spark: SparkSession, path: str, parse: Callable[[bytes], str]) -> DataFrame:
    """One row per binary file: location and the parser's text, in Arrow batches."""
    import pandas as pd

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: parse(bytes(b)))

    run.__annotations__ = {"contents": pd.Series, "return": pd.Series}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("location"), F.pandas_udf(run, "string")("content").alias("content"))


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word file."""
    import io
    import re
    import zipfile

    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    return "\n".join("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in paragraphs)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of the files: location, last_modified, size; e_tag and version are unknown here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("location"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size"), F.lit(None).cast("string").alias("e_tag"), F.lit(None).cast("string").alias("version"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **properties: str) -> DataFrame:
    """A database table (or a sub-query: then the whole query runs there), read in ranges of a column if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def unnest(df: DataFrame, depth: int) -> DataFrame:
    """Lifts the fields of nested objects to the root, ``depth`` levels deep; arrays stay.

    A name that then occurs twice is an error.
    """
    for _ in range(depth):
        columns, names = [], []
        for f in df.schema.fields:
            inner = [g.name for g in f.dataType.fields] if isinstance(f.dataType, T.StructType) else [None]
            for g in inner:
                columns.append(F.col(f"`{f.name}`") if g is None else F.col(f"`{f.name}`.`{g}`").alias(g))
                names.append(f.name if g is None else g)
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ValueError(f"unnesting would give two columns {sorted(twice)}")
        df = df.select(*columns)
    return df


def single_fields(df: DataFrame) -> DataFrame:
    """Columns that are lists of one-field objects as lists of that field's values."""
    def value(name: str):
        return lambda x: x[name]

    columns = []
    for f in df.schema.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
        column = F.col(f"`{f.name}`")
        one = isinstance(inner, T.StructType) and len(inner.fields) == 1
        columns.append(F.transform(column, value(inner.fields[0].name)).alias(f.name) if one else column)
    return df.select(*columns)


class PagedJson(DataSource):
    """A source of JSON pages, each naming the next: ``spark.read.format("paged_json")``.

    Options: ``fetch`` (module:function from a cursor, or None, to the page as text),
    ``pointer`` (the path to the rows, as /a/b), ``next`` (that to the next cursor)
    and ``starts`` (a JSON list of first cursors, each a task of its own).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _Start(InputPartition):
    def __init__(self, cursor: str | None):
        self.cursor = cursor


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Start(c) for c in json.loads(self.options.get("starts", "[null]"))]

    def read(self, partition: _Start) -> Iterator[tuple[str]]:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        fetch, cursor = getattr(importlib.import_module(module), name), partition.cursor
        while True:
            page = json.loads(fetch(cursor))
            rows = at(page, self.options["pointer"]) or []
            for row in rows if isinstance(rows, list) else [rows]:
                yield (json.dumps(row),)
            cursor = at(page, self.options.get("next", "/next"))
            if not cursor:
                return


def at(value, pointer: str):
    """What a JSON pointer names, or None."""
    for key in pointer.strip("/").split("/") if pointer.strip("/") else []:
        if isinstance(value, list):
            value = value[int(key)] if key.isdigit() and int(key) < len(value) else None
        else:
            value = value.get(key) if isinstance(value, dict) else None
        if value is None:
            return None
    return value


def read_paged(spark: SparkSession, fetch: str, schema: T.StructType | str, pointer: str, next_pointer: str = "/next", starts: list[str | None] | None = None, depth: int = 0) -> DataFrame:
    """Rows of a paged JSON service, parsed and unnested."""
    spark.dataSource.register(PagedJson)
    raw = spark.read.format("paged_json").options(fetch=fetch, pointer=pointer, next=next_pointer, starts=json.dumps(starts or [None])).load()
    return unnest(raw.select(F.from_json("value", schema).alias("r")).select("r.*"), depth)
