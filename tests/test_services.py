"""Web services, metric payloads, retries and sinks."""

from __future__ import annotations

import json
import random
import threading
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import types as T

from lakeloom.operators import retry
from lakeloom.sources import services, sinks
from lakeloom.sources.scratch import new_dir


def test_read_http(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r.location: bytes(r.content) for r in services.read_http(spark, [f"{base}/a", f"{base}/b"]).collect()}
    server.shutdown()
    assert got == {f"{base}/a": b"/a", f"{base}/b": b"/b"}


def test_repository_schemas_parse(spark):
    for ddl in services.REPOSITORY_TABLES.values():
        assert len(T._parse_datatype_string(ddl).fields) >= 8


def test_repository_pages(spark):
    got = services.read_repository(spark, "issues", "tests.test_services:pages").orderBy("number").collect()
    assert [(r.number, r.labels, r.assignees) for r in got] == [(1, ["bug", "new"], []), (2, None, ["ann"])]
    assert got[0].comments[0].author.login == "bo" and got[0].created_at.year == 2024


def pages(cursor):
    first = {"number": 1, "labels": [{"name": "bug"}, {"name": "new"}], "assignees": [], "comments": [{"author": {"login": "bo"}, "body": "x"}], "created_at": "2024-05-01T00:00:00Z"}
    second = {"number": 2, "assignees": [{"login": "ann"}]}
    return json.dumps({"data": {"rows": [first] if cursor is None else [second], "next": "more" if cursor is None else None}})


def test_histograms_and_summaries(spark):
    times = {"timeUnixNano": "1700000000123456000", "startTimeUnixNano": "1700000000000000000"}
    metrics = [{"name": "h", "histogram": {"dataPoints": [times | {"count": "3", "sum": 6.5, "min": 0.5, "max": 4.0, "bucketCounts": ["1", "2"], "explicitBounds": [1.0]}]}}, {"name": "s", "summary": {"dataPoints": [times | {"count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.5}]}]}}]
    payload = spark.createDataFrame([(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]}),)], "value string")
    h, s = services.decode_histograms(payload).first(), services.decode_summaries(payload).first()
    assert (h.name, h["count"], h["sum"], h.min, h.max, h.bucket_counts, h.explicit_bounds) == ("h", 3, 6.5, 0.5, 4.0, [1, 2], [1.0])
    assert (s.name, s["count"], s["sum"], s.quantiles, s.time.microsecond) == ("s", 2, 3.0, {0.5: 1.5}, 123456)
    assert services.decode_metrics(payload).count() == 0


def test_filters_become_search_terms():
    filters = [("state", "=", "open"), ("title", "like", "%two words%"), ("author", "!=", "bot"), ("labels", "array_contains", "bug"), ("number", ">", 5), ("title", "like", "a%b")]
    terms, left = services.search_arguments(filters, {"state": "state", "title": "title", "author": "author", "labels": "label"})
    assert terms == ["state:open", 'title:"two words"', "-author:bot", "label:bug"]
    assert left == [("title", "like", "%two words%"), ("number", ">", 5), ("title", "like", "a%b")]


def test_metric_points(spark):
    point = {"timeUnixNano": "1700000000123456000", "startTimeUnixNano": "1700000000000000000", "attributes": [{"key": "host", "value": {"stringValue": "a"}}, {"key": "n", "value": {"intValue": "3"}}]}
    metrics = [{"name": "cpu", "gauge": {"dataPoints": [point | {"asDouble": 0.5}]}}, {"name": "hits", "sum": {"dataPoints": [point | {"asInt": "7"}, point | {"asInt": "8", "attributes": []}]}}]
    payload = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]})
    got = sorted((r.name, r.value, r.attributes, r.time.microsecond) for r in services.decode_metrics(spark.createDataFrame([(payload,)], "value string")).collect())
    assert got == [("cpu", 0.5, {"host": "a", "n": "3"}, 123456), ("hits", 7.0, {"host": "a", "n": "3"}, 123456), ("hits", 8.0, {}, 123456)]


def test_waits_and_retries():
    assert list(retry.waits(7)) == [1, 1, 2, 3, 5, 8, 13] and max(retry.waits(40, longest=60)) == 60
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert retry.with_retry(flaky, 5, slept.append) == "done" and slept == [1, 1]

    def broken():
        raise retry.Permanent("no")

    with pytest.raises(retry.Permanent):
        retry.with_retry(broken, 5, slept.append)
    rng = random.Random(1)
    assert all(timedelta(seconds=5) <= retry.jittered(timedelta(seconds=10), timedelta(seconds=5), rng) <= timedelta(seconds=15) for _ in range(50))
    assert retry.jittered(timedelta(0), timedelta(seconds=5), random.Random(3)) >= timedelta(0)


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string").coalesce(1)
    assert json.loads(sinks.json_array(df)) == [{"id": 1, "v": "a"}, {"id": 2}]
    assert sinks.csv_text(df).splitlines()[0] == '"id","v"' and len(sinks.csv_text(df).splitlines()) == 3
    path = new_dir(spark, "sink")
    n = sinks.dual_write(df, lambda d: sinks.write_files(d, f"{path}/a"), lambda d: sinks.write_files(d.fillna("b"), f"{path}/b", "csv", by=["id"]) or d.count())
    assert n == 2 and spark.read.parquet(f"{path}/a").count() == 2 and spark.read.option("header", "true").csv(f"{path}/b").count() == 2
