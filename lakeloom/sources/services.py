"""Rows from web services: files over HTTP, repository APIs with pushed-down filters, metric payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.readers import read_paged, single_fields

#: Columns of a code-hosting service's tables, as its pages give them.
REPOSITORY_TABLES = {
    "issues": "id string, number bigint, title string, url string, author string, body string, created_at timestamp, updated_at timestamp, closed_at timestamp, state string, milestone_id string, milestone_title string, labels array<struct<name string>>, comments_count bigint, comments array<struct<author struct<login string>, body string>>, assignees array<struct<login string>>",
    "pulls": "additions bigint, assignees array<struct<login string>>, author string, body string, changed_files bigint, closed_at timestamp, comments_count bigint, commits_count bigint, created_at timestamp, deletions bigint, hashes array<struct<id string>>, id string, labels array<struct<name string>>, merged_at timestamp, number bigint, reviews_count bigint, state string, title string, updated_at timestamp, url string",
    "commits": "sha string, id string, author_name string, author_email string, committed_date timestamp, message string, message_body string, message_head_line string, additions bigint, deletions bigint",
    "stargazers": "starred_at timestamp, login string, email string, name string, company string, x_username string, location string, avatar_url string, bio string",
}


def read_repository(spark: SparkSession, table: str, fetch: str, pointer: str = "/data/rows", next_pointer: str = "/data/next", starts: list[str | None] | None = None) -> DataFrame:
    """A table of a code-hosting service, read page by page; lists of one-field objects become lists of their values.

    ``fetch`` is as for :func:`lakeloom.sources.readers.read_paged`.
    """
    return single_fields(read_paged(spark, fetch, REPOSITORY_TABLES[table], pointer, next_pointer, starts))


def read_http(spark: SparkSession, urls: list[str], timeout: float = 60.0) -> DataFrame:
    """One row per URL: location and content as bytes; the tasks download."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.request import urlopen

        for batch in batches:
            for url in batch.column("location").to_pylist():
                with urlopen(url, timeout=timeout) as answer:
                    yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([answer.read()], pa.binary())], names=["location", "content"])

    return spark.createDataFrame([(u,) for u in urls], "location string").repartition(max(1, len(urls))).mapInArrow(run, "location string, content binary")


def fetch_http(spark: SparkSession, urls: list[str], path: str, timeout: float = 60.0, piece: int = 1 << 20) -> None:
    """Copies files of a web server into a folder that all executors share, each by a task and a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        from urllib.parse import urlsplit
        from urllib.request import urlopen

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for url in batch.column("location").to_pylist():
                name = urlsplit(url).path.rpartition("/")[2] or "index"
                files.create_dir(root)
                temporary = f"{root}/_temporary-{uuid.uuid4().hex}"
                with urlopen(url, timeout=timeout) as answer, files.open_output_stream(temporary) as out:
                    while data := answer.read(piece):
                        out.write(data)
                files.move(temporary, f"{root}/{name}")
                yield batch

    spark.createDataFrame([(u,) for u in urls], "location string").repartition(max(1, len(urls))).mapInArrow(run, "location string").collect()


def search_arguments(filters: list[tuple[str, str, object]], columns: dict[str, str]) -> tuple[list[str], list[tuple[str, str, object]]]:
    """Splits filters (column, operator, value) into search terms of the service and those that stay with Spark.

    Equality, ``like`` with wild cards at the ends and ``array_contains`` can be
    pushed for the columns that have a term; pushed ones but equality are applied again.
    """
    terms, left = [], []
    for column, operator, value in filters:
        term = columns.get(column)
        text = str(value).strip("%") if operator == "like" else str(value)
        if term is None or operator not in ("=", "!=", "like", "array_contains") or "%" in text:
            left.append((column, operator, value))
            continue
        quoted = f'"{text}"' if re.search(r"\s", text) else text
        terms.append(f"{'-' if operator == '!=' else ''}{term}:{quoted}")
        if operator == "like":
            left.append((column, operator, value))
    return terms, left


_ATTRIBUTES = "attributes array<struct<key string, value struct<stringValue string, intValue string, doubleValue double, boolValue boolean>>>"
_TIMES = f"timeUnixNano string, startTimeUnixNano string, {_ATTRIBUTES}"
_POINT = f"struct<{_TIMES}, asDouble double, asInt string>"
_HISTOGRAM = f"struct<{_TIMES}, count string, sum double, min double, max double, bucketCounts array<string>, explicitBounds array<double>>"
_SUMMARY = f"struct<{_TIMES}, count string, sum double, quantileValues array<struct<quantile double, value double>>>"
_METRICS = f"struct<resourceMetrics array<struct<scopeMetrics array<struct<metrics array<struct<name string, gauge struct<dataPoints array<{_POINT}>>, sum struct<dataPoints array<{_POINT}>>, histogram struct<dataPoints array<{_HISTOGRAM}>>, summary struct<dataPoints array<{_SUMMARY}>>>>>>>>>"


def _metrics(payloads: DataFrame, value: str) -> DataFrame:
    parsed = payloads.select(F.from_json(F.col(value).cast("string"), _METRICS).alias("p"))
    return parsed.select(F.explode("p.resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))


def _point_columns() -> list:
    attribute = lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value"))
    at = lambda c: F.timestamp_micros((F.col(c).cast("decimal(20,0)") / 1000).cast("long"))
    return [at("d.timeUnixNano").alias("time"), at("d.startTimeUnixNano").alias("start_time"), F.map_from_entries(F.transform(F.coalesce("d.attributes", F.array()), attribute)).alias("attributes")]


def decode_metrics(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Points of gauges and sums in JSON payloads of metrics: name, time, start_time, attributes, value.

    One table holds all metrics; ``where name = …`` is one metric's table.
    """
    none = F.array().cast(f"array<{_POINT}>")
    points = _metrics(payloads, value).select("m.name", F.explode(F.concat(F.coalesce("m.gauge.dataPoints", none), F.coalesce("m.sum.dataPoints", none))).alias("d"))
    return points.select("name", *_point_columns(), F.coalesce("d.asDouble", F.col("d.asInt").cast("double")).alias("value"))


def decode_histograms(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Points of histograms: name, time, start_time, attributes, count, sum, min, max, bucket_counts, explicit_bounds."""
    points = _metrics(payloads, value).select("m.name", F.explode("m.histogram.dataPoints").alias("d"))
    return points.select("name", *_point_columns(), F.col("d.count").cast("long").alias("count"), "d.sum", "d.min", "d.max", F.col("d.bucketCounts").cast("array<long>").alias("bucket_counts"), F.col("d.explicitBounds").alias("explicit_bounds"))


def decode_summaries(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Points of summaries: name, time, start_time, attributes, count, sum and quantiles (a map to their values)."""
    points = _metrics(payloads, value).select("m.name", F.explode("m.summary.dataPoints").alias("d"))
    return points.select("name", *_point_columns(), F.col("d.count").cast("long").alias("count"), "d.sum", F.map_from_entries("d.quantileValues").alias("quantiles"))
