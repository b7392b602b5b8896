"""Applying change rows (op, sequence, data) to a table, set by set rather than row by row."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Create, update and snapshot-read write a row; delete removes it; truncate, message and others are ignored.
WRITES, DELETE = ("c", "u", "r"), "d"


def change_schema(table: T.StructType) -> T.StructType:
    """Schema of a change batch of a table."""
    return T.StructType([T.StructField("op", T.StringType()), T.StructField("primary_keys", T.ArrayType(T.StringType())), T.StructField("data", table)])


def apply_changes(existing: DataFrame, changes: DataFrame, key: list[str], sequence: str = "seq") -> DataFrame:
    """``existing`` after all changes; of several for a key the one with the largest sequence counts.

    ``changes`` has op, ``sequence`` and the struct ``data``. Keys may be composite
    and of any type: rows go if all key columns agree. One aggregate (combined
    before its shuffle) and one anti-join, both on the key.
    """
    rows = changes.where(F.col("op").isin(*WRITES, DELETE)).select(*[F.col(f"data.{k}").alias(k) for k in key], F.col(sequence).alias("__seq"), "op", "data")
    last = rows.groupBy(*key).agg(F.max_by(F.struct("op", "data"), "__seq").alias("__last"))
    kept = existing.join(last.select(*key), key, "left_anti").select(*existing.columns)
    written = last.where(F.col("__last.op") != DELETE).select(*[F.col(f"__last.data.{c}").alias(c) for c in existing.columns])
    return kept.unionByName(written)


#: Types of the envelope's own schema.
_TYPES = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "float32": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.StringType()}


def _field_type(field: dict) -> T.DataType:
    if field["type"] == "array":
        return T.ArrayType(_field_type(field["items"]))
    if field["type"] == "struct":
        return T.StructType([T.StructField(f["field"], _field_type(f), f.get("optional", True)) for f in field["fields"]])
    return _TYPES[field["type"]]


def discover_debezium(messages: DataFrame, key: str = "key", value: str = "value") -> tuple[T.StructType, dict[str, tuple[str, int]], list[str]]:
    """From one message that carries schemas: the table's fields as they are encoded, the logical types (name and scale) by column, and the primary key.

    Only one message reaches the driver. Without a key in it, the primary key is empty.
    """
    one = messages.where(F.get_json_object(F.col(value).cast("string"), "$.schema.fields").isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v")).first()
    if one is None:
        raise ValueError("no message carries a schema")
    envelope = {f["field"]: f for f in json.loads(one["v"])["schema"]["fields"]}
    row = envelope.get("after") or envelope["before"]
    kinds = {f["field"]: (f["name"], int(f.get("parameters", {}).get("scale", 0))) for f in row["fields"] if f.get("name")}
    of_key = json.loads(one["k"]) if one["k"] else {}
    names = [f["field"] for f in of_key.get("schema", {}).get("fields", [])] or list(of_key.get("payload", of_key))
    return _field_type(row), kinds, names


def decode_debezium(values: DataFrame, table: T.StructType, value: str = "value", kinds: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Change rows from JSON envelopes: op, ts_ms and data (``before`` for deletes, else ``after``).

    Envelopes with and without a ``payload`` level are understood. Columns named in
    ``kinds`` (logical type and scale) are turned into what they mean.
    """
    if kinds:
        raw = decode_debezium(values, table, value)
        columns = [debezium_value(F.col(f"data.{f.name}"), *kinds[f.name]).alias(f.name) if f.name in kinds else F.col(f"data.{f.name}") for f in table.fields]
        return raw.withColumn("data", F.when(F.col("data").isNotNull(), F.struct(*columns)))
    body = T.StructType([T.StructField("before", table), T.StructField("after", table), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType())])
    wrapped = F.from_json(F.col(value).cast("string"), T.StructType([T.StructField("payload", body), *body.fields]))
    parsed = values.withColumn("__v", wrapped)
    pick = lambda f: F.coalesce(F.col(f"__v.payload.{f}"), F.col(f"__v.{f}"))
    op = pick("op")
    return parsed.select(op.alias("op"), pick("ts_ms").alias("ts_ms"), F.when(op == DELETE, pick("before")).otherwise(pick("after")).alias("data")).where("op IS NOT NULL")


def debezium_value(column, kind: str, scale: int = 0):
    """A logical type's value: Date (days), Time and Timestamp (ms), Micro… (µs), Zoned… (ISO text), Decimal (base64)."""
    name = kind.rpartition(".")[2]
    if name == "Date":
        return F.date_add(F.lit("1970-01-01").cast("date"), column.cast("int"))
    if name in ("Timestamp", "MicroTimestamp"):
        return (F.timestamp_millis(column) if name == "Timestamp" else F.timestamp_micros(column)).cast("timestamp_ntz")
    if name in ("Time", "MicroTime"):
        us = column.cast("long") * (1000 if name == "Time" else 1)
        return F.date_format(F.timestamp_micros(us), "HH:mm:ss.SSSSSS")
    if name in ("ZonedTimestamp", "ZonedTime"):
        return F.to_timestamp(column) if name == "ZonedTimestamp" else column
    if name == "Decimal":  # big-endian two's complement of up to 124 bits
        digits = F.hex(F.unbase64(column))
        negative = F.substr(digits, F.lit(1), F.lit(1)) >= "8"
        size = F.when(negative, F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(digits)
        whole = F.right(F.lpad(size, 32, "0"), F.lit(31))
        high, low = (F.conv(x, 16, 10).cast("decimal(20,0)") for x in (F.substr(whole, F.lit(1), F.lit(16)), F.substr(whole, F.lit(17))))
        value = (high * F.lit(Decimal(16**15)) + low).cast("decimal(38,0)")
        signed = F.when(negative, -value - 1).otherwise(value)
        return (signed * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
    return column
