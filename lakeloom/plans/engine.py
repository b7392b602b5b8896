"""The engine: datasets, views, read-only SQL with a results cache, writes, refreshes, system tables."""

from __future__ import annotations

import re
import time
import uuid
from collections import OrderedDict, deque
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import sql_names
from lakeloom.operators import refresh as ops
from lakeloom.operators.changes import apply_changes
from lakeloom.operators.retry import Permanent, with_retry
from lakeloom.sources.readers import format_of, listing, read_files, read_jdbc
from lakeloom.sources.scratch import new_dir
from lakeloom.sources.services import fetch_http
from lakeloom.sources.store import Store

#: Statements that only read.
READS = ("select", "with", "values", "table", "from", "explain", "describe", "desc", "show", "(")
UNCACHED = ("explain", "describe", "desc", "show")
HISTORY_KEPT, METRICS_KEPT = timedelta(hours=8), timedelta(minutes=30)
#: Entries of the history, and of the metrics, that the driver holds at most.
EVENTS_KEPT = 10_000


@dataclass
class Acceleration:
    """How a dataset is kept locally."""

    path: str
    mode: str = "full"  # full, append, changes or disabled
    refresh_sql: str | None = None
    data_window: timedelta | None = None
    overlap: timedelta = timedelta(0)
    retention: timedelta | None = None
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    on_conflict: dict[tuple[str, ...], str] = field(default_factory=dict)
    on_zero_results: str = "return_empty"  # or use_source
    retries: int = 3


@dataclass
class DatasetSpec:
    """A named table: where it comes from, whether it can be written, its time column, how it is kept."""

    name: str
    source: str | DataFrame | None  # None: a sink, whose first write gives the schema
    mode: str = "read"  # or read_write
    file_format: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    hive_partitions: bool = False
    time_column: str | None = None
    time_format: str | None = None
    acceleration: Acceleration | None = None
    has_metadata_table: bool = False


class ReadOnly(ValueError):
    """The statement would change something."""


#: Comments, quoted texts (with doubled or escaped quotes) and quoted names, whichever begins first.
_QUOTED = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", re.S)


def _bare(sql: str) -> str:
    """The statement without comments, and with empty quotes."""
    return _QUOTED.sub(lambda m: " " if m[0][:2] in ("--", "/*") else "''", sql).strip().rstrip(";").strip()


def check_read_only(sql: str) -> str:
    """The statement's first word; an error unless it is one statement that only reads."""
    text = _bare(sql)
    first = "(" if text.startswith("(") else (re.match(r"\w+", text) or [""])[0].lower()
    if ";" in text or first not in READS:
        raise ReadOnly("only one reading statement is allowed; write through Engine.write")
    if first in ("with", "from", "explain") and re.search(r"\b(insert\s+(into|overwrite)|delete\s+from|update\s+\w+\s+set|merge\s+into|create\s|drop\s|alter\s)", text, re.I):
        raise ReadOnly("only reading statements are allowed; write through Engine.write")
    return first


#: What the parsed plan of a refresh statement may consist of.
REFRESH_NODES = ("Project", "Filter", "Sort", "GlobalLimit", "LocalLimit", "UnresolvedRelation")


def check_refresh_sql(sql: str, table: str) -> None:
    """A refresh statement selects all columns of its own table alone; filters, order and limit may follow.

    What counts is Spark's parsed plan: one relation, nothing but filters, order and
    limits above it, no subqueries, and all columns.
    """
    wrong = ValueError(f"a refresh statement must be SELECT * FROM {table} with optional WHERE, ORDER BY and LIMIT")
    text = sql.strip().rstrip(";")
    if not re.match(r"select\b", text, re.I):
        raise wrong
    try:
        plan = SparkSession.active().sql(f"EXPLAIN EXTENDED {text}").first()[0]
    except ParseException as e:
        raise wrong from e
    parsed = plan.split("== Analyzed Logical Plan ==")[0].split("\n")[1:]
    nodes = [m for line in parsed if (m := re.match(r"[ :]*(?:\+- )?'?(\w+)(.*)", line))]
    relations = [m[2] for m in nodes if m[1] == "UnresolvedRelation"]
    whole = [m[2].strip() for m in nodes if m[1] == "Project"]
    if any(m[1] not in REFRESH_NODES for m in nodes) or len(relations) != 1 or whole != ["[*]"] or not re.match(rf"\s*\[{re.escape(table)}\]", relations[0]) or re.search(r"subquery|exists#|IN \(list#|outer\(", "\n".join(parsed)):
        raise wrong


class ResultsCache:
    """Finished results as tables in the shared folder, by plan and the versions of the tables in it.

    Least recently used go first. A result is written by Spark and never passes the
    driver; one that is larger than the cache is kept for its reader alone.
    """

    def __init__(self, max_bytes: int = 128 << 20, ttl: float = 1.0):
        self.max_bytes, self.ttl, self.entries, self.size = max_bytes, ttl, OrderedDict(), 0

    def get(self, key, df: DataFrame) -> DataFrame | None:
        """The fresh result of the same plan: equal keys are compared in full."""
        at, asked, found, _ = self.entries.get(key, (0.0, None, None, 0))
        if found is None or time.monotonic() - at > self.ttl or not asked.sameSemantics(df):
            self.drop(key)
            return None
        self.entries.move_to_end(key)
        return found

    def drop(self, key) -> None:
        if key in self.entries:
            self.size -= self.entries.pop(key)[3]

    def put(self, key, asked: DataFrame, found: DataFrame, size: int) -> None:
        self.drop(key)
        if size > self.max_bytes:
            return
        self.entries[key] = (time.monotonic(), asked, found, size)
        self.size += size
        while self.size > self.max_bytes:
            self.drop(next(iter(self.entries)))

    def invalidate(self, table: str) -> None:
        for key in [k for k in self.entries if table in dict(k[1])]:
            self.drop(key)


class Engine:
    """Datasets and views of one session."""

    def __init__(self, spark: SparkSession, cache: ResultsCache | None = None):
        self.spark, self.cache = spark, cache or ResultsCache()
        sql_names.register(spark)
        self.specs: dict[str, DatasetSpec] = {}
        self.versions: dict[str, int] = {}
        self.views: dict[str, str] = {}
        self.copies: dict[str, str] = {}
        self.history: deque[tuple] = deque(maxlen=EVENTS_KEPT)
        self.metrics: deque[tuple] = deque(maxlen=EVENTS_KEPT)

    # ---- datasets and views

    def source(self, spec: DatasetSpec) -> DataFrame:
        """The dataset where it comes from: a DataFrame, files, a database table (``jdbc:`` with option ``dbtable``) or a file of a web server, copied once a registration or refresh."""
        if isinstance(spec.source, DataFrame):
            return spec.source
        if spec.source.startswith("jdbc:"):
            options = dict(spec.options)
            return read_jdbc(self.spark, spec.source, options.pop("dbtable", spec.name), **options)
        if re.match(r"https?://", spec.source):
            if spec.source not in self.copies:
                self.copies[spec.source] = new_dir(self.spark, "web")
                fetch_http(self.spark, [spec.source], self.copies[spec.source])
            return read_files(self.spark, self.copies[spec.source], format_of(spec.source, spec.file_format), spec.hive_partitions, **spec.options)
        return read_files(self.spark, spec.source, spec.file_format, spec.hive_partitions, **spec.options)

    def register(self, spec: DatasetSpec) -> None:
        """Makes the dataset a table; a kept one is refreshed if it has no version yet."""
        if spec.acceleration and spec.acceleration.refresh_sql:
            check_refresh_sql(spec.acceleration.refresh_sql, spec.name)
        if spec.acceleration and spec.acceleration.on_conflict:
            keys = [tuple(k) for k in (spec.acceleration.primary_key, *spec.acceleration.unique) if k]
            ops.check_conflicts(spec.acceleration.on_conflict, keys)
        if isinstance(spec.source, str):
            self.copies.pop(spec.source, None)
        if spec.acceleration and spec.source is not None:
            missing = {c for k in (spec.acceleration.primary_key, *spec.acceleration.unique) for c in k} - set(self.source(spec).columns)
            if missing:
                raise ValueError(f"{spec.name} has no columns {sorted(missing)} for its keys")
        self.specs[spec.name] = spec
        if spec.acceleration and spec.acceleration.mode in ("full", "append") and spec.source is not None and Store(self.spark, spec.acceleration.path).latest() is None:
            self.refresh(spec.name)
        if spec.source is not None or self.table_exists(spec.name):
            self._publish(spec.name)
        if spec.has_metadata_table and isinstance(spec.source, str):
            listing(self.spark, spec.source).createOrReplaceTempView(f"metadata_{spec.name}")

    def table_exists(self, name: str) -> bool:
        """Whether the dataset has a schema: a sink has none before its first write."""
        spec = self.specs[name]
        return spec.source is not None or (spec.acceleration is not None and Store(self.spark, spec.acceleration.path).latest() is not None)

    def _publish(self, name: str) -> None:
        self.table(name).createOrReplaceTempView(name)
        self.versions[name] = self.versions.get(name, 0) + 1
        self.cache.invalidate(name)

    def table(self, name: str) -> DataFrame:
        spec = self.specs[name]
        if spec.acceleration is None:
            return self.source(spec)
        kept = Store(self.spark, spec.acceleration.path).read()
        return self.source(spec).limit(0) if kept is None else kept

    def scan(self, name: str, condition) -> DataFrame:
        """Rows that fulfil the condition, from the source if the dataset says so and the kept table has none."""
        spec = self.specs[name]
        if spec.acceleration and spec.acceleration.on_zero_results == "use_source":
            return ops.with_fallback(self.table(name), self.source(spec), condition)
        return self.table(name).where(condition)

    def register_views(self, views: dict[str, str]) -> list[str]:
        """Creates views in an order in which each one's inputs exist; returns that order."""
        left, order = dict(views), []
        while left:
            ready = [v for v, sql in left.items() if not any(re.search(rf"\b{re.escape(o)}\b", sql) for o in left if o != v)]
            if not ready:
                raise ValueError(f"views {sorted(left)} depend on each other")
            for v in ready:
                check_read_only(left[v])
                self.spark.sql(left.pop(v)).createOrReplaceTempView(v)
                order.append(v)
        self.views |= views
        return order

    # ---- queries

    def sql(self, text: str) -> DataFrame:
        """Runs one reading statement lazily.

        It is Spark's SQL, with the functions of :mod:`lakeloom.functions.sql_names`. System tables may be named as runtime.*, metadata.* and information_schema.*.
        If a dataset in it falls back to its source and the kept rows give no result
        row, the statement reads the sources of such datasets instead.
        """
        started = datetime.now(UTC)
        error = None
        try:
            check_read_only(text)
            text = self._named(text)
            df = self.spark.sql(text)
            fallback = [n for n, s in self.specs.items() if s.acceleration and s.acceleration.on_zero_results == "use_source" and re.search(rf"\b{re.escape(n)}\b", _bare(text))]
            if fallback and df.isEmpty():
                for name in fallback:
                    self.source(self.specs[name]).createOrReplaceTempView(name)
                df = self.spark.sql(text)
                for name in fallback:
                    self.table(name).createOrReplaceTempView(name)
            return df
        except Exception as e:
            error = type(e).__name__
            raise
        finally:
            self.history.append((uuid.uuid4().hex, "sql_query", text, started, datetime.now(UTC), error))

    def _named(self, text: str) -> str:
        """Functions and system tables under the names that they have in the session; system tables are published if one is named."""
        kept: list[str] = []
        bare = _QUOTED.sub(lambda m: kept.append(m[0]) or f"\0{len(kept) - 1}\0", text)
        called = sql_names.in_sql(bare)
        named = re.sub(r"\b(runtime|metadata|information_schema)\.(\w+)", r"\1_\2", called, flags=re.I)
        if named != called:
            self.system_tables()
        return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], named)

    def fetch(self, text: str) -> DataFrame:
        """The statement's finished result, from the cache while it is fresh and no table in it has changed."""
        first = check_read_only(text)
        df = self.sql(text)
        if first in UNCACHED or re.search(r"\b(runtime|metadata|information_schema)[_.]", text):
            return df
        used = tuple(sorted((t, v) for t, v in self.versions.items() if re.search(rf"\b{re.escape(t)}\b", text + " ".join(s for n, s in self.views.items() if n in text))))
        key = (df.semanticHash(), used)
        found = self.cache.get(key, df)
        if found is None:
            path = new_dir(self.spark, "result")
            df.write.parquet(path)
            found = self.spark.read.schema(df.schema).parquet(path)
            size = listing(self.spark, path).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            self.cache.put(key, df, found, size)
        return found

    # ---- changes

    def write(self, name: str, df: DataFrame, mode: str = "append") -> int:
        """Adds or replaces rows of a writable dataset; a kept dataset with a file source is written in both places."""
        spec = self.specs[name]
        if spec.mode != "read_write":
            raise ReadOnly(f"{name} can't be written")
        if self.table_exists(name):
            ops.check_write(df, self.table(name).schema)
            df = df.toDF(*self.table(name).columns)
        if spec.acceleration:
            store = Store(self.spark, spec.acceleration.path)
            if isinstance(spec.source, str):
                df = df.persist()
                df.write.mode(mode).format(spec.file_format or "parquet").save(spec.source)
            if mode == "overwrite":
                n = store.overwrite(df)
            elif spec.acceleration.on_conflict and store.latest() is not None:
                n = store.overwrite(ops.resolve_conflicts(self.table(name), df, spec.acceleration.on_conflict))
            else:
                n = store.append(df)
            df.unpersist()
        else:
            written = Observation()
            df.observe(written, F.count(F.lit(1)).alias("n")).write.mode(mode).format(spec.file_format or "parquet").save(spec.source)
            n = written.get["n"]
        self._publish(name)
        return n

    def delete(self, name: str, condition) -> DataFrame:
        """Deletes rows of a kept dataset; returns their count."""
        kept, count = ops.delete_where(self.table(name), condition)
        n = count.first()["count"]
        Store(self.spark, self.specs[name].acceleration.path).overwrite(kept)
        self._publish(name)
        return self.spark.createDataFrame([(n,)], "count long")

    def refresh(self, name: str, mode: str | None = None, sql: str | None = None, now: datetime | None = None) -> int:
        """Refreshes a kept dataset; mode and statement may be given for this time alone.

        Transient failures are retried as often as the dataset says, those of the statement or settings are not.
        """
        spec = self.specs[name]
        if spec.acceleration is None:
            raise ValueError(f"{name} isn't accelerated")
        return with_retry(lambda: self._refresh(name, mode, sql, now), spec.acceleration.retries, permanent=(Permanent, ValueError, AnalysisException))

    def _refresh(self, name: str, mode: str | None, sql: str | None, now: datetime | None) -> int:
        spec = self.specs[name]
        acc, store = spec.acceleration, Store(self.spark, spec.acceleration.path)
        if isinstance(spec.source, str):
            self.copies.pop(spec.source, None)
        now, source = now or datetime.now(UTC), self.source(spec)
        statement = sql or acc.refresh_sql
        if statement:
            check_refresh_sql(statement, name)
            source.createOrReplaceTempView(name)
            source = self.spark.sql(statement)
        existing, mode = store.read(), mode or acc.mode
        if acc.data_window and spec.time_column:
            source = ops.full_refresh(source, spec.time_column, acc.data_window, now, spec.time_format)
        if mode == "full" or existing is None and mode == "append":
            n = store.overwrite(source)
        elif mode == "append":
            if spec.time_column is None:
                raise ValueError("append needs a time column or a stream")
            rows = ops.append_refresh(source, existing, spec.time_column, acc.overlap, spec.time_format)
            n = store.overwrite(ops.resolve_conflicts(existing, rows, acc.on_conflict)) if acc.on_conflict else store.append(rows)
        elif mode == "disabled":
            return 0
        else:
            raise ValueError(f"{mode} is fed by a stream")
        self.metrics.append(("refresh_rows", datetime.now(UTC), name, float(n)))
        self._publish(name)
        return n

    def set_refresh_sql(self, name: str, sql: str) -> None:
        check_refresh_sql(sql, name)
        self.specs[name].acceleration.refresh_sql = sql

    def apply(self, name: str, changes: DataFrame, sequence: str = "seq") -> int:
        """Applies a batch of change rows to a kept dataset."""
        acc = self.specs[name].acceleration
        n = Store(self.spark, acc.path).overwrite(apply_changes(self.table(name), changes, acc.primary_key, sequence))
        self._publish(name)
        return n

    def retain(self, name: str, now: datetime | None = None) -> int:
        """Deletes what is older than the dataset's retention; returns the rows left."""
        spec = self.specs[name]
        kept = ops.retain(self.table(name), spec.time_column, spec.acceleration.retention, now or datetime.now(UTC), spec.time_format)
        n = Store(self.spark, spec.acceleration.path).overwrite(kept)
        self._publish(name)
        return n

    # ---- system tables

    def system_tables(self, now: datetime | None = None) -> None:
        """Publishes runtime_task_history, runtime_metrics, runtime_datasets and information_schema_tables and _columns, without what is past its retention."""
        now = now or datetime.now(UTC)
        spans = [h for h in self.history if h[4] >= now - HISTORY_KEPT]
        values = [m for m in self.metrics if m[1] >= now - METRICS_KEPT] + [("query_count", now, None, float(len(spans)))]
        create = self.spark.createDataFrame
        create(spans, "trace_id string, task string, input string, start_time timestamp, end_time timestamp, error_message string").createOrReplaceTempView("runtime_task_history")
        create(values, "name string, time timestamp, dataset string, value double").createOrReplaceTempView("runtime_metrics")
        rows = [(n, s.source if isinstance(s.source, str) else "dataframe", s.acceleration is not None, s.mode) for n, s in self.specs.items()]
        create(rows, "name string, source string, accelerated boolean, mode string").createOrReplaceTempView("runtime_datasets")
        listed = self.tables()
        listed.createOrReplaceTempView("information_schema_tables")
        columns = [(r.table_schema, r.table_name, f.name, k + 1, f.dataType.simpleString(), "YES" if f.nullable else "NO") for r in listed.collect() for k, f in enumerate(self.spark.table(r.table_name).schema.fields)]
        create(columns, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string").createOrReplaceTempView("information_schema_columns")

    def table_schema(self, name: str) -> str:
        """The table as a CREATE TABLE text."""
        return f"CREATE TABLE {name} (\n" + ",\n".join(f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in self.table(name).schema.fields) + "\n)"

    def tables(self, schema: str | None = None) -> DataFrame:
        """Catalog, schema, name and type of every table: datasets are ``public``, system tables ``runtime``, listings ``metadata``."""
        rows = []
        for t in self.spark.catalog.listTables():
            kind = next((k for k in ("runtime", "metadata", "information_schema") if t.name.startswith(f"{k}_")), "public")
            if t.name in self.specs or t.name in self.views or kind != "public":
                rows.append(("lakeloom", kind, t.name, "VIEW" if t.name in self.views else "BASE TABLE"))
        found = self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")
        return found if schema is None else found.where(F.col("table_schema") == schema)

    def schema_prompt(self, names: list[str] | None = None) -> str:
        """The tables as CREATE TABLE texts, for a prompt."""
        return "\n\n".join(self.table_schema(n) for n in names or self.specs)

    def primary_keys(self) -> dict[str, list[str]]:
        return {n: s.acceleration.primary_key for n, s in self.specs.items() if s.acceleration and s.acceleration.primary_key}
