"""Refreshing a materialized table: full, incremental append, changes, conflicts, retention.

All are functions from DataFrames to DataFrames with an explicit ``now``; nothing is
collected. Time columns are ``timestamp``, ``timestamptz``, ``unix_seconds``,
``unix_millis`` or ``ISO8601`` text.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("timestamp", "timestamptz", "unix_seconds", "unix_millis", "ISO8601")


def check_time_format(kind: T.DataType, time_format: str | None) -> str:
    """The format to use for a time column of this type; an error if they don't fit."""
    if isinstance(kind, T.StringType):
        wanted = ("ISO8601",)
    elif isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
        wanted = ("unix_seconds", "unix_millis")
    elif isinstance(kind, T.TimestampNTZType):
        wanted = ("timestamp",)
    elif isinstance(kind, T.TimestampType):
        wanted = ("timestamptz",)
    else:
        raise ValueError(f"a time column can't be of type {kind.simpleString()}")
    if time_format is None:
        return wanted[0]
    if time_format not in wanted:
        raise ValueError(f"time format {time_format} doesn't fit type {kind.simpleString()}")
    return time_format


def as_micros(column: Column, time_format: str) -> Column:
    """A time column as microseconds since 1970 (UTC)."""
    if time_format == "unix_seconds":
        return (column * 1_000_000).cast("long")
    if time_format == "unix_millis":
        return (column * 1_000).cast("long")
    return F.unix_micros(F.to_timestamp(column) if time_format == "ISO8601" else column.cast("timestamp"))


def time_literal(at: datetime, kind: T.DataType, time_format: str) -> Column:
    """The moment ``at`` (UTC) as a value to compare the bare column with, so filters reach the scan."""
    if time_format == "unix_seconds":
        return F.lit(int(at.timestamp()))
    if time_format == "unix_millis":
        return F.lit(int(at.timestamp() * 1000))
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind if not isinstance(kind, T.StringType) else "timestamp")


def after(df: DataFrame, time_column: str, at: datetime, time_format: str | None = None, inclusive: bool = False) -> Column:
    """The predicate ``time_column > at``."""
    kind = df.schema[time_column].dataType
    form = check_time_format(kind, time_format)
    column = F.to_timestamp(time_column) if form == "ISO8601" else F.col(time_column)
    value = time_literal(at, kind, form)
    return column >= value if inclusive else column > value


def full_refresh(source: DataFrame, time_column: str | None = None, window: timedelta | None = None, now: datetime | None = None, time_format: str | None = None) -> DataFrame:
    """All rows of the source, or those later than ``now - window``."""
    if time_column is None or window is None:
        return source
    return source.where(after(source, time_column, now - window, time_format))


def later(df: DataFrame, time_column: str, micros: int, form: str) -> Column:
    """The predicate that a time column is later than ``micros``; it compares the bare column, so it reaches the scan.

    Text (ISO8601) has to be parsed first and can't be pushed down.
    """
    kind = df.schema[time_column].dataType
    if form == "ISO8601":
        return as_micros(F.col(time_column), form) > micros
    if form in ("unix_seconds", "unix_millis"):
        per = 1_000_000 if form == "unix_seconds" else 1_000
        whole = isinstance(kind, T.IntegralType)
        return F.col(time_column) > F.lit(micros // per if whole else micros / per)  # a whole number is above a bound if it is above its floor
    return F.col(time_column) > F.timestamp_micros(F.lit(micros)).cast(kind)


def append_refresh(source: DataFrame, existing: DataFrame, time_column: str, overlap: timedelta = timedelta(0), time_format: str | None = None) -> DataFrame:
    """The rows to append: later than the latest existing time less ``overlap``, and not yet there.

    The latest time is one aggregate of the bare column; both sides are filtered by it
    in their scans. Existing rows of the window are taken out by a null-safe comparison
    of all columns. The anti-join is hashed on all of them.
    """
    form = check_time_format(source.schema[time_column].dataType, time_format)
    top = F.max(as_micros(F.col(time_column), form)) if form == "ISO8601" else as_micros(F.max(time_column), form)
    latest = existing.agg(top.alias("t")).first()["t"]
    if latest is None:
        return source
    since = latest - int(overlap.total_seconds() * 1_000_000)
    # Only in seconds or milliseconds is the source coarser than the microseconds compared.
    fresh = source.where(later(source, time_column, since, form))
    if not overlap:
        return fresh
    return new_rows(fresh, existing.where(later(existing, time_column, since, form)))


def new_rows(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``fresh`` that equal no row of ``existing`` in the columns of ``existing``; null equals null."""
    common = [c for c in existing.columns if c in fresh.columns]
    # One hash of all columns is the join's key; every column is then compared.
    left = fresh.withColumn("__h", F.xxhash64(*common))
    right = existing.select(F.xxhash64(*common).alias("__g"), *[F.col(c).alias(f"__e_{c}") for c in common])
    same = F.col("__h") == F.col("__g")
    for c in common:
        same &= F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    return left.join(right, same, "left_anti").drop("__h")


def retain(df: DataFrame, time_column: str, period: timedelta, now: datetime, time_format: str | None = None) -> DataFrame:
    """Without the rows older than ``now - period`` (exactly as old ones stay, as do rows without a time)."""
    keep = after(df, time_column, now - period, time_format, inclusive=True)
    return df.where(F.coalesce(keep, F.lit(True)))


def delete_where(df: DataFrame, condition: Column | str) -> tuple[DataFrame, DataFrame]:
    """What stays, and a one-row table ``count`` of what goes. Rows where the condition is null stay."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.agg(F.count(F.when(gone, 1)).alias("count"))


def check_conflicts(targets: dict[tuple[str, ...], str], keys: list[tuple[str, ...]]) -> None:
    """Several targets must all drop, one for each key."""
    if set(targets.values()) - {"drop", "upsert"}:
        raise ValueError("a conflict is resolved by drop or upsert")
    if len(targets) > 1 and (set(targets.values()) != {"drop"} or len(targets) != len(keys)):
        raise ValueError("with several conflict targets, each key needs one and all must be drop")
    if any(t not in keys for t in targets):
        raise ValueError("a conflict target must be a primary key or unique index")


def last_of_key(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """For each key the row with the largest sequence, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def once_a_key(new: DataFrame, key: list[str], sequence: str | None = None) -> DataFrame:
    """One row of each key, that with the largest ``sequence`` if one is named; keys with a null are never equal."""
    whole = F.lit(True)
    for k in key:
        whole &= F.col(k).isNotNull()
    full = new.where(whole)
    return (last_of_key(full, key, sequence) if sequence else full.dropDuplicates(key)).unionByName(new.where(~whole))


def resolve_conflicts(existing: DataFrame, new: DataFrame, targets: dict[tuple[str, ...], str], keys: list[tuple[str, ...]] | None = None, sequence: str | None = None) -> DataFrame:
    """``existing`` with ``new`` rows: upsert replaces rows of equal key, drop keeps them.

    Of new rows that share a key one counts: the one with the largest ``sequence``,
    or any if none is named.
    """
    check_conflicts(targets, keys or list(targets))
    for target, how in targets.items():
        new = once_a_key(new, list(target), sequence)
        if how == "upsert":
            return existing.join(new.select(*target), list(target), "left_anti").select(*existing.columns).unionByName(new)
        new = new.join(existing.select(*target), list(target), "left_anti").select(*new.columns)
    return existing.unionByName(new)


def with_fallback(local: DataFrame, source: DataFrame, condition: Column | str) -> DataFrame:
    """Rows of the local table that fulfil the condition, or the source's if there are none.

    It stays one plan: the source is scanned only if the local count is zero.
    """
    found = local.where(condition)
    none = found.limit(1).agg((F.count("*") == 0).alias("__none"))
    return found.unionByName(source.where(condition).join(F.broadcast(none), F.col("__none"), "left_semi").select(*found.columns))


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, cast; missing nullable ones are null, other missing ones an error."""
    columns = []
    for f in schema.fields:
        if f.name in df.columns:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name} is missing and can't be null")
    return df.select(*columns)


def check_write(df: DataFrame, schema: T.StructType) -> None:
    """Arity and types must fit by position; names aren't compared."""
    if len(df.schema) != len(schema):
        raise ValueError(f"{len(schema)} columns are expected, {len(df.schema)} given")
    for have, want in zip(df.schema.fields, schema.fields):
        if have.dataType != want.dataType:
            raise ValueError(f"column {want.name}: {want.dataType.simpleString()} is expected, {have.dataType.simpleString()} given")
