"""Queries of the library's own operators, with SQL for the same rows where there is one.

``now`` and cut-offs are constants, so results don't depend on the day.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import scalar as S
from lakeloom.functions.registry import call
from lakeloom.functions.vectors import array_distance, cosine_distance, vector
from lakeloom.operators import metrics, refresh, sampling, search
from lakeloom.operators.changes import apply_changes, change_schema, debezium_value, decode_debezium, discover_debezium
from lakeloom.plans.engine import Acceleration, DatasetSpec, Engine
from lakeloom.sources.readers import listing, read_files, single_fields, unnest
from lakeloom.sources.scratch import new_dir
from lakeloom.sources.store import Store
from lakeloom.streaming import streams

NOW = datetime(2024, 1, 30, 12, tzinfo=UTC)
CUT = "2024-01-15 00:00:00"
QUERY = [1.0 if k % 3 == 0 else -0.5 for k in range(64)]
ORACLE_QUERY = "[" + ", ".join(map(str, QUERY)) + "]"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None):
    """Adds a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- functions


@register("SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01 00:05:00') AS bin FROM events")
def fn_date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.date_bin(15 * 60 * 1_000_000, F.col("ts"), "2024-01-01 00:05:00").alias("bin"))


@register("""
    SELECT p_partkey, regexp_replace(p_brand, '(\\w)\\w*#', '\\1-') AS first_only, regexp_replace(p_brand, '[a-z]', '*', 'g') AS all_of, regexp_extract(p_brand, '(\\w+)#(\\d+)', 2) AS second,
           concat(p_brand, NULL, p_type) AS joined, left(p_name, -2) AS but_two, right(p_name, -2) AS from_third, strpos(p_name, 'i') AS at_i, lower(to_hex(p_size)) AS hexed, chr(8364) AS euro, trunc(p_retailprice) AS cut_off FROM part""")
def fn_postgres(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, name = F.col("p_brand"), F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.regexp_replace(brand, r"(\w)\w*#", r"\1-").alias("first_only"), S.regexp_replace(brand, "[a-z]", "*", "g").alias("all_of"), S.regexp_match(brand, r"(\w+)#(\d+)")[1].alias("second"),
        S.concat(brand, F.lit(None).cast("string"), F.col("p_type")).alias("joined"), S.left(name, -2).alias("but_two"), S.right(name, -2).alias("from_third"), S.strpos(name, "i").cast("long").alias("at_i"),
        S.to_hex(F.col("p_size")).alias("hexed"), S.chr_(F.lit(8364)).alias("euro"), S.trunc(F.col("p_retailprice")).alias("cut_off"),
    )


@register("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text, json_contains(json_keys(props)::JSON, '"k"') AS has_k,
           false AS has_x, CAST(len(json_keys(props)) AS INT) AS n FROM events""")
def json_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", S.json_get_int(p, "k").alias("k"), S.json_get_str(p, "k").alias("k_text"), S.json_contains(p, "k").alias("has_k"), S.json_contains(p, "x").alias("has_x"), S.json_length(p).alias("n"))


@register("SELECT p_partkey, list_contains([p_brand, p_type], 'PROMO') AS has_promo, [p_brand, p_type][1] AS first_of, len([p_size, 2, 3]) AS n FROM part")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array("p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_contains(both, "PROMO").alias("has_promo"), F.element_at(both, 1).alias("first_of"), F.size(F.array("p_size", F.lit(2), F.lit(3))).cast("long").alias("n"))


@register("""
    SELECT event_id, make_timestamp(event_id * 1000000) AS by_seconds, make_timestamp(event_id * 1000) AS by_millis, make_timestamp(event_id) AS by_micros,
           make_timestamp(event_id * 1000000) AS by_unix, date_trunc('day', ts) AS day, CAST(date_part('hour', ts) AS INT) AS h FROM events""")
def fn_time_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, plain = F.col("event_id"), lambda c: c.cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id", plain(call("to_timestamp_seconds", i)).alias("by_seconds"), plain(call("to_timestamp_millis", i)).alias("by_millis"), plain(call("to_timestamp_micros", i)).alias("by_micros"),
        plain(call("from_unixtime", i)).alias("by_unix"), plain(call("datetrunc", "day", "ts")).alias("day"), call("datepart", F.lit("hour"), F.col("ts")).cast("int").alias("h"),
    )


@register("SELECT p_partkey, 32 AS uuid_length_without_dashes, true AS in_range, 'Int64' AS kind, 'Utf8' AS text_kind, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS capital, true AS today FROM part")
def fn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose values change from run to run, by what stays; names of types; capitals."""
    r = call("random")
    return table(spark, sf_dir, "part").select("p_partkey", F.length(F.replace(call("uuid"), F.lit("-"), F.lit(""))).alias("uuid_length_without_dashes"), ((r >= 0) & (r < 1)).alias("in_range"), call("arrow_typeof", F.col("p_partkey")).alias("kind"), call("arrow_typeof", F.col("p_name")).alias("text_kind"), call("initcap", F.col("p_type")).alias("capital"), (call("current_date") <= F.to_date(call("now"))).alias("today"))


# ---- vectors


@register(f"SELECT vec_id, label, round((1 - list_cosine_similarity(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[])) / 2, 6) AS dist FROM embeddings ORDER BY (1 - list_cosine_similarity(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[])), vec_id LIMIT 10")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").withColumn("dist", cosine_distance(F.col("embedding"), vector(QUERY)))
    return found.orderBy(F.col("dist").asc_nulls_last(), "vec_id").limit(10).select("vec_id", "label", F.round("dist", 6).alias("dist"))


@register(f"SELECT vec_id, round(1 - (1 - list_cosine_similarity(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[])) / 2, 6) AS score, label FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[]) DESC, vec_id LIMIT 3")
def vec_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").withColumnsRenamed({"embedding": "v_embedding"}).withColumn("v", F.col("vec_id").cast("string"))
    found = search.vector_search(df, "v", ["vec_id"], search.SearchRequest(QUERY, where="label = 3", additional_columns=["label"]), "embeddings")
    return found.select(F.col("primary_key.vec_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("metadata.label").alias("label"))


@register(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[]), 5) AS d FROM embeddings")
def vec_array_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(array_distance(F.col("embedding"), vector(QUERY)), 5).alias("d"))


@register()
def vec_chunk_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of whole documents, embedded by hashed words."""
    embedder = search.hash_embedder(64)
    docs = search.embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", embedder, target_chunk=400)
    request = search.SearchRequest(QUERY, limit=10)
    return search.vector_search(docs, "text", ["doc_id"], request, "documents").select("value", "score", "dataset", F.col("primary_key.doc_id").alias("doc_id"))


# ---- sampling


@register("""
    WITH a AS (SELECT p_brand, row_number() OVER (ORDER BY pr, p_brand) AS n FROM (SELECT 1 AS pr, p_brand FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 2, p_brand FROM part) ORDER BY n LIMIT 40),
         b AS (SELECT p_type, row_number() OVER (ORDER BY pr, p_type) AS n FROM (SELECT 1 AS pr, p_type FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 2, p_type FROM part) ORDER BY n LIMIT 40)
    SELECT p_brand, p_type FROM a FULL JOIN b USING (n)""")
def sample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_distinct(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 40)


@register("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 12")
def sample_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_top(table(spark, sf_dir, "part"), "ORDER BY p_size DESC, p_partkey", 12).select("p_partkey", "p_size", "p_name")


@register("SELECT CAST(count(*) AS BIGINT) AS rows_of_the_table FROM (SELECT * FROM part LIMIT 7)")
def sample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any seven rows; how many of them are rows of the table."""
    part = table(spark, sf_dir, "part")
    return sampling.sample_first(part, 7).intersect(part).agg(F.count("*").alias("rows_of_the_table"))


# ---- materialization


@register("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-23 12:00:00'")
def mat_full_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.full_refresh(table(spark, sf_dir, "events"), "ts", timedelta(days=7), NOW).select("event_id", "user_id", "value")


def _old_and_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    changed = F.when(F.col("event_id") % 7 == 0, F.lit("changed")).otherwise(F.col("event_type"))
    return events.where(f"ts <= timestamp_ntz'{CUT}'"), events.withColumn("event_type", changed)


_OLD = f"old AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS value, props FROM events WHERE ts <= TIMESTAMP '{CUT}')"
_SOURCE = "src AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN 'changed' ELSE event_type END AS event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS value, props FROM events)"


@register(f"WITH {_OLD}, {_SOURCE} SELECT * FROM src WHERE ts > (SELECT max(ts) FROM old) - INTERVAL '6 hours' EXCEPT ALL SELECT * FROM old")
def mat_append_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, source = _old_and_source(spark, sf_dir)
    return refresh.append_refresh(source, old, "ts", timedelta(hours=6))


@register("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def mat_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.retain(table(spark, sf_dir, "events"), "ts", timedelta(days=10), NOW).select("event_id", "ts", "value")


def _conflicting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderkey % 10 <> 3"), orders.where("o_orderkey % 10 < 4").withColumn("o_totalprice", F.col("o_totalprice") + 1000)


_EXISTING = "ex AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3), nw AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1000 AS o_totalprice FROM orders WHERE o_orderkey % 10 < 4)"


@register(f"WITH {_EXISTING} SELECT * FROM ex WHERE o_orderkey NOT IN (SELECT o_orderkey FROM nw) UNION ALL SELECT * FROM nw")
def mat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.resolve_conflicts(*_conflicting(spark, sf_dir), {("o_orderkey",): "upsert"})


@register(f"WITH {_EXISTING} SELECT * FROM ex UNION ALL SELECT * FROM nw WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ex)")
def mat_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.resolve_conflicts(*_conflicting(spark, sf_dir), {("o_orderkey",): "drop"})


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def mat_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return refresh.with_fallback(orders.where("o_orderstatus <> 'P'"), orders, "o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")


@register("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice, CAST(NULL AS VARCHAR) AS p_note FROM part")
def mat_schema_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.LongType()), T.StructField("p_retailprice", T.StringType()), T.StructField("p_note", T.StringType())])
    return refresh.cast_to(table(spark, sf_dir, "part"), wanted)


@register("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice < 50000) AS deleted FROM orders WHERE (o_totalprice < 50000) IS NOT TRUE")
def mat_delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a delete leaves, and how many it took."""
    left, count = refresh.delete_where(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice < 50000")
    return left.crossJoin(F.broadcast(count.withColumnRenamed("count", "deleted")))


@register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 1")
def mat_store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overwrite and an append as versions of a stored table, then its current one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = Store(spark, new_dir(spark, "store"))
    store.overwrite(orders.where("o_orderkey % 3 = 2"))
    store.overwrite(orders.where("o_orderkey % 3 = 0"))
    store.append(orders.where("o_orderkey % 3 = 1"))
    return store.read()


# ---- changes


_OPS = "CASE o_orderkey % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'u' WHEN 2 THEN 'd' WHEN 3 THEN 'r' ELSE 't' END"


@register(f"""
    WITH ch AS (SELECT o_orderkey, {_OPS} AS op, o_totalprice * 2 AS p FROM orders)
    SELECT o.o_orderkey, o.o_orderstatus, CASE WHEN ch.op IN ('c', 'u', 'r') THEN ch.p ELSE o.o_totalprice END AS o_totalprice
    FROM orders o JOIN ch USING (o_orderkey) WHERE ch.op IN ('c', 'u', 'r') OR (ch.op = 't' AND o_orderkey % 2 = 0) ORDER BY 1""")
def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    doubled = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    both = orders.select(F.lit(1).alias("seq"), F.lit("d").alias("op"), F.struct(*orders.columns).alias("data")).unionByName(doubled.select(F.lit(2).alias("seq"), F.expr(_OPS).alias("op"), F.struct(*orders.columns).alias("data")))
    return apply_changes(orders.where("o_orderkey % 2 = 0"), both.where("seq = 2"), ["o_orderkey"])


@register("""
    WITH k AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN p % 4 = 1 THEN 100 ELSE 0 END AS l_quantity FROM k WHERE p % 4 <> 2""")
def cdc_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes and updates by a key of two columns; lines of one order are told apart."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("l_quantity"))
    raised = lines.withColumn("l_quantity", F.col("l_quantity") + 100)
    data = F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("data")
    changes = raised.where("p % 4 = 1").select(F.lit(1).alias("seq"), F.lit("u").alias("op"), data).unionByName(lines.where("p % 4 = 2").select(F.lit(1).alias("seq"), F.lit("d").alias("op"), data))
    return apply_changes(lines.select("l_orderkey", "l_linenumber", "l_quantity"), changes, ["l_orderkey", "l_linenumber"])


@register("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name, p_size + 1 FROM part WHERE p_partkey % 4 = 1")
def cdc_debezium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON envelopes decoded and applied: updates of a quarter, deletes of another."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    row, more = F.struct("p_partkey", "p_name", "p_size"), F.struct("p_partkey", "p_name", (F.col("p_size") + 1).alias("p_size"))
    updates = part.where("p_partkey % 4 = 1").select(F.to_json(F.struct(F.struct(row.alias("before"), more.alias("after"), F.lit("u").alias("op"), F.lit(2).alias("ts_ms")).alias("payload"))).alias("value"))
    deletes = part.where("p_partkey % 4 = 3").select(F.to_json(F.struct(row.alias("before"), F.lit("d").alias("op"), F.lit(3).alias("ts_ms"))).alias("value"))
    return apply_changes(part, decode_debezium(updates.unionByName(deletes), part.schema), ["p_partkey"], "ts_ms")


#: What a connector sends along with rows of this table; columns of every logical type.
_ENVELOPE = """{"type": "struct", "fields": [{"field": "before", "type": "struct", "optional": true, "fields": []}, {"field": "after", "type": "struct", "optional": true, "fields": [
    {"field": "o_orderkey", "type": "int64", "optional": false}, {"field": "day", "type": "int32", "name": "io.debezium.time.Date"}, {"field": "at_us", "type": "int64", "name": "io.debezium.time.MicroTimestamp"},
    {"field": "at_ms", "type": "int64", "name": "io.debezium.time.Timestamp"}, {"field": "clock", "type": "int32", "name": "io.debezium.time.Time"}, {"field": "clock_us", "type": "int64", "name": "io.debezium.time.MicroTime"},
    {"field": "zoned", "type": "string", "name": "io.debezium.time.ZonedTimestamp"}, {"field": "price", "type": "bytes", "name": "org.apache.kafka.connect.data.Decimal", "parameters": {"scale": "2"}}, {"field": "status", "type": "string"}]}]}"""


@register("""
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderdate AS at_us, o_orderdate AS at_ms, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(o_orderkey % 86400), '%H:%M:%S') || '.000000' AS clock,
           strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(o_orderkey % 86400), '%H:%M:%S') || '.000000' AS clock_us, o_orderdate AS zoned, CAST(CAST((CAST(round(o_totalprice * 100) AS BIGINT) - 20000000) AS DOUBLE) / 100 AS DOUBLE) AS price, o_orderstatus AS status FROM orders""")
def cdc_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table and key found in the messages' own schemas, logical types decoded, changes applied to an empty table."""
    orders = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    cents = (F.round(F.col("o_totalprice") * 100) - 20_000_000).cast("long")
    row = F.struct(
        "o_orderkey", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")).alias("day"), F.unix_micros("ts").alias("at_us"), F.unix_millis("ts").alias("at_ms"), (F.col("o_orderkey") % 86400 * 1000).alias("clock"),
        (F.col("o_orderkey") % 86400 * 1_000_000).alias("clock_us"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("zoned"), F.base64(F.unhex(F.lpad(F.hex(cents), 16, "0"))).alias("price"), F.col("o_orderstatus").alias("status"),
    )
    payload = F.to_json(F.struct(row.alias("after"), F.lit("c").alias("op"), F.lit(1).alias("ts_ms")))
    messages = orders.select(F.to_json(F.struct(F.struct("o_orderkey").alias("payload"))).alias("key"), F.format_string('{"schema": %s, "payload": %s}', F.lit(_ENVELOPE), payload).alias("value"))
    schema, kinds, key = discover_debezium(messages)
    changes = decode_debezium(messages, schema, kinds=kinds)
    empty = changes.select("data.*").limit(0)
    found = apply_changes(empty, changes, key, "ts_ms")
    return found.withColumns({"day": F.col("day").cast("string"), "zoned": F.col("zoned").cast("timestamp_ntz"), "price": F.col("price").cast("double")})


@register("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderdate AS at FROM orders")
def cdc_logical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    encoded = orders.select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).alias("d"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return encoded.select("o_orderkey", debezium_value(F.col("d"), "io.debezium.time.Date").cast("string").alias("day"), debezium_value(F.col("us"), "io.debezium.time.MicroTimestamp").alias("at"))


# ---- streams


@register("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files, streamed into a stored table."""
    base, events = new_dir(spark, "stream"), table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    store = Store(spark, f"{base}/table")
    streams.append_stream(streams.file_stream(spark, f"{base}/in", events.schema, files_per_batch=2), store, f"{base}/checkpoint").awaitTermination()
    return store.read(events.schema)


@register("SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)")
def stream_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows as files, applied batch by batch."""
    base = new_dir(spark, "changes")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    data = F.struct("o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice")).alias("data")
    changes = orders.select(F.expr(_OPS).alias("op"), F.array(F.lit("o_orderkey")).alias("primary_keys"), data, F.lit(1).alias("seq"))
    changes.repartition(3, "data.o_orderkey").write.parquet(f"{base}/in")
    schema = T.StructType([*change_schema(orders.schema).fields, T.StructField("seq", T.IntegerType())])
    store = Store(spark, f"{base}/table")
    streams.changes_stream(streams.file_stream(spark, f"{base}/in", schema, files_per_batch=1), store, orders.schema, ["o_orderkey"], f"{base}/checkpoint").awaitTermination()
    return store.read(orders.schema)


@register("SELECT event_id, ts, value FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice, streamed; duplicates within the overlap go."""
    base = new_dir(spark, "dedup")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.unionByName(events).repartition(4, "event_id").write.parquet(f"{base}/in")
    stream = streams.deduplicated(streams.file_stream(spark, f"{base}/in", events.schema), "ts", "60 days", ["event_id"])
    streams.parquet_sink(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- sources, engine, metrics


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, user_id AS id, event_type AS name FROM events")
def unnest_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name")).alias("user")).alias("node"))
    return unnest(nested, 2)


@register("SELECT doc_id, CAST(unnest(range(1, len(w) + 1)) AS INT) AS nth, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def arrays_unnest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document with its place, by DataFrame functions (``arrays_unnest``: in SQL)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.select("doc_id", (F.col("pos") + 1).alias("nth"), "word")


@register("SELECT p_partkey, [p_brand, p_type] AS labels, len([p_brand, p_type]) AS n FROM part")
def list_of_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one-field objects as lists of values."""
    nested = table(spark, sf_dir, "part").select("p_partkey", F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("labels"))
    return single_fields(nested).withColumn("n", F.size("labels").cast("long"))


@register("SELECT p_partkey, p_name, p_brand FROM part")
def src_hive_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with one folder a brand, its key read back as text."""
    path = new_dir(spark, "hive")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").repartition(F.col("p_brand"), F.pmod("p_partkey", F.lit(8))).write.partitionBy("p_brand").parquet(path)
    return read_files(spark, path, "parquet", hive_partitions=True).select("p_partkey", "p_name", "p_brand")


@register("SELECT c_custkey, c_name, c_acctbal FROM customer")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", "true").csv(path)
    return read_files(spark, path, "csv").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


@register("SELECT p_brand, count(*) AS rows_inside, CAST(1 AS BIGINT) AS files, true AS sized FROM part GROUP BY p_brand")
def src_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of a folder with one CSV file a brand, beside the rows in it."""
    path, part = new_dir(spark, "files"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    part.repartition("p_brand").write.partitionBy("p_brand").csv(path)
    listed = listing(spark, path).where(F.col("location").endswith(".csv")).select(F.url_decode(F.regexp_extract("location", "p_brand=([^/]+)", 1)).alias("p_brand"), "size")
    files = listed.groupBy("p_brand").agg(F.count("*").alias("files"), F.min("size").alias("least"))
    return part.groupBy("p_brand").agg(F.count("*").alias("rows_inside"), F.sum(F.length(F.col("p_partkey").cast("string")) + 1).alias("bytes")).join(files, "p_brand").select("p_brand", "rows_inside", "files", (F.col("least") == F.col("bytes")).alias("sized"))


@register("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY n_name UNION ALL SELECT 'all' AS n_name, count(*) AS customers, CAST(0 AS DOUBLE) AS balance FROM nation")
def engine_federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of an embedded database (it lives in a local session's own process) joined with, and added to, one of files."""
    url = f"jdbc:derby:memory:lakeloom{uuid.uuid4().hex}"
    nation = table(spark, sf_dir, "nation")
    nation.write.format("jdbc").options(url=f"{url};create=true", dbtable="nation", createTableColumnTypes="n_name VARCHAR(100)").save()
    engine = Engine(spark)
    engine.register(DatasetSpec("engine_db_nation", url, options={"dbtable": "nation"}))
    engine.register(DatasetSpec("engine_customer", f"{sf_dir}/customer.parquet", file_format="parquet"))
    return engine.sql("""
        SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM engine_db_nation JOIN engine_customer ON c_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY n_name
        UNION ALL SELECT 'all' AS n_name, count(*) AS customers, CAST(0 AS DOUBLE) AS balance FROM engine_db_nation""")


@register("SELECT n_regionkey, count(*) AS nations, sum(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even FROM nation GROUP BY n_regionkey")
def engine_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views given out of order over a registered dataset, queried through the read-only engine."""
    engine = Engine(spark)
    engine.register(DatasetSpec("engine_nation", f"{sf_dir}/nation.parquet", file_format="parquet"))
    engine.register_views({"engine_top": "SELECT n_regionkey, count(*) AS nations, sum(even) AS even FROM engine_flagged GROUP BY n_regionkey", "engine_flagged": "SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 1L ELSE 0L END AS even FROM engine_nation"})
    return engine.sql("SELECT n_regionkey, nations, even FROM engine_top")


@register(r"""
    SELECT p_partkey, CAST(strpos(p_name, 'i') AS INT) AS at_i, starts_with(p_type, 'PROMO') AS promo, lower(to_hex(p_size)) AS hexed, sha256(p_name) AS s256, 56 AS l224, 96 AS l384, 128 AS l512, sha256(p_name) AS digested,
           round(log10(p_size), 8) AS log_ten, round(log2(p_size), 8) AS log_two, trunc(p_retailprice) AS cut_off, round(trunc(p_retailprice * 10) / 10, 4) AS cut_one, chr(8364) AS euro, left(p_name, -2) AS but_two, left(p_name, 3) AS first_three, right(p_name, 2) AS last_two,
           substr(p_name, 1, 2) AS from_zero, p_brand || p_type AS joined, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS capital, regexp_extract(p_brand, '(\w+)#(\d+)', 2) AS second, regexp_extract(p_brand, '\d+') AS whole, regexp_replace(p_brand, '(\w)\w*#', '\1-') AS first_only, regexp_replace(p_brand, '[A-Z]', '*', 'gi') AS all_of, p_name AS none_of, 'log(x) -- ''left(' AS quoted FROM part""")
def engine_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by their advertised names in the engine's SQL text."""
    engine = Engine(spark)
    engine.register(DatasetSpec("engine_part", f"{sf_dir}/part.parquet", file_format="parquet"))
    return engine.sql(r"""
        SELECT p_partkey, strpos(p_name, 'i') AS at_i, starts_with(p_type, 'PROMO') AS promo, to_hex(p_size) AS hexed, sha256(p_name) AS s256, length(sha224(p_name)) AS l224, length(sha384(p_name)) AS l384, length(sha512(p_name)) AS l512, lower(hex(digest(p_name, 'sha256'))) AS digested,
               round(log(p_size), 8) AS log_ten, round(log(2, p_size), 8) AS log_two, trunc(p_retailprice) AS cut_off, round(trunc(p_retailprice, 1), 4) AS cut_one, chr(8364) AS euro, left(p_name, -2) AS but_two, LEFT(p_name, 3) AS first_three, right(p_name, 2) AS last_two,
               substr(p_name, 0, 3) AS from_zero, concat(p_brand, NULL, p_type) AS joined, initcap(p_type) AS capital, regexp_match(p_brand, '(\\w+)#(\\d+)')[1] AS second, regexp_match(p_brand, '\\d+')[0] AS whole,
               regexp_replace(p_brand, '(\\w)\\w*#', '\\1-') AS first_only, regexp_replace(p_brand, '[A-Z]', '*', 'gi') AS all_of, regexp_replace(p_name, 'x+y', '$') AS none_of, 'log(x) -- \'left(' AS quoted -- trunc(
        FROM engine_part""")


@register(f"""
    SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01 00:05:00') AS bin, make_timestamp(event_id * 1000000) AS by_seconds, make_timestamp(event_id * 1000) AS by_millis, make_timestamp(event_id) AS by_micros, make_timestamp(event_id * 1000000) AS by_unix, date_trunc('day', ts) AS day,
           json_extract_string(props, '$.k') AS k_text, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) AS k_float, true AS has_k, false AS has_x, 1 AS n FROM events""")
def engine_time_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and JSON functions by their advertised names in the engine's SQL text."""
    engine = Engine(spark)
    engine.register(DatasetSpec("engine_stream", f"{sf_dir}/events.parquet", file_format="parquet"))
    found = engine.sql("""
        SELECT event_id, date_bin(INTERVAL '15' MINUTE, ts, TIMESTAMP'2024-01-01 00:05:00') AS bin, to_timestamp_seconds(event_id) AS by_seconds, to_timestamp_millis(event_id) AS by_millis, to_timestamp_micros(event_id) AS by_micros, from_unixtime(event_id) AS by_unix, datetrunc('day', ts) AS day,
               json_get_str(props, 'k') AS k_text, json_get_int(props, 'k') AS k, json_get_float(props, 'k') AS k_float, json_contains(props, 'k') AS has_k, json_contains(props, 'x') AS has_x, json_length(props) AS n
        FROM engine_stream""")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bin", "by_seconds", "by_millis", "by_micros", "by_unix", "day")})


@register(f"SELECT vec_id, round((1 - list_cosine_similarity(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[])) / 2, 6) AS dist, round(list_distance(embedding::DOUBLE[], {ORACLE_QUERY}::DOUBLE[]), 5) AS d FROM embeddings")
def engine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector distances by name in the engine's SQL text."""
    engine = Engine(spark)
    engine.register(DatasetSpec("engine_vectors", f"{sf_dir}/embeddings.parquet", file_format="parquet"))
    query = "array(" + ", ".join(f"{x}D" for x in QUERY) + ")"
    return engine.sql(f"SELECT vec_id, round(cosine_distance(embedding, {query}), 6) AS dist, round(array_distance(embedding, {query}), 5) AS d FROM engine_vectors")


@register(f"SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '{CUT}'")
def engine_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept dataset with a refresh statement and a data window."""
    engine = Engine(spark)
    acceleration = Acceleration(new_dir(spark, "kept"), refresh_sql="SELECT * FROM engine_events WHERE event_type = 'click'", data_window=NOW - datetime(2024, 1, 15, tzinfo=UTC))
    spec = DatasetSpec("engine_events", table(spark, sf_dir, "events"), time_column="ts", acceleration=acceleration)
    engine.specs[spec.name] = spec
    engine.refresh(spec.name, now=NOW)
    return engine.sql("SELECT event_id, ts, value FROM engine_events")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def engine_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink takes the schema of its first write; a second one is appended."""
    engine, orders = Engine(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    engine.register(DatasetSpec("engine_sink_table", None, mode="read_write", acceleration=Acceleration(new_dir(spark, "sink"))))
    engine.write("engine_sink_table", orders.where("o_orderkey % 4 = 0"))
    engine.write("engine_sink_table", orders.where("o_orderkey % 4 = 1"))
    return engine.sql("SELECT o_orderkey, o_totalprice FROM engine_sink_table")


@register("""
    WITH b AS (SELECT l_returnflag, unnest([10, 20, 30, 40]) AS le FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
    c AS (SELECT b.l_returnflag, b.le, count(l_quantity) AS n FROM b JOIN lineitem l ON l.l_returnflag = b.l_returnflag AND l_quantity <= b.le GROUP BY ALL),
    t AS (SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY ALL),
    w AS (SELECT c.*, lag(n, 1, 0) OVER w AS before, lag(le, 1, 0) OVER w AS low, total FROM c JOIN t USING (l_returnflag) WINDOW w AS (PARTITION BY l_returnflag ORDER BY le))
    SELECT l_returnflag, round(min(low + (le - low) * ((total * 0.5 - before) / (n - before))), 6) AS p50 FROM w WHERE n >= total * 0.5 AND before < total * 0.5 GROUP BY l_returnflag""")
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.bucket_counts(table(spark, sf_dir, "lineitem"), "l_quantity", [10.0, 20.0, 30.0, 40.0], ["l_returnflag"])
    return counts.select("l_returnflag", F.round(metrics.percentile(F.col("buckets"), 0.5), 6).alias("p50"))
