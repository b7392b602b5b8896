"""The advertised scalar functions under their names in SQL text.

Names that Spark lacks become temporary SQL functions, which Catalyst inlines. Names
that mean something else in Spark can't be replaced there; :func:`in_sql` writes
calls of them under a name of their own. Null order, division of whole numbers and
subscripts stay Spark's: write NULLS LAST, ``div`` and ``element_at``.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_WIDTH = "(extract(day FROM w) * 86400000000 + extract(hour FROM w) * 3600000000 + extract(minute FROM w) * 60000000 + CAST(extract(second FROM w) * 1000000 AS BIGINT))"
_AT = "get_json_object(x, concat('$[''', k, ''']'))"
_GROUPS = r"size(regexp_extract_all(p, '(?<!\\\\)\\((?!\\?)', 0))"
_PATTERN = "concat(CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '' END, p)"
_BY = r"regexp_replace(replace(r, '$', '\\$'), '\\\\(\\d)', '\\$$1')"
_SQUARE = "aggregate({}, 0D, (t, v) -> t + v * v)"

#: Arguments, type and body by name.
DEFINED: dict[str, tuple[str, str, str]] = {
    "strpos": ("x STRING, part STRING", "INT", "locate(part, x)"),
    "starts_with": ("x STRING, part STRING", "BOOLEAN", "startswith(x, part)"),
    "to_hex": ("x BIGINT", "STRING", "lower(hex(x))"),
    "sha224": ("x STRING", "STRING", "sha2(x, 224)"),
    "sha256": ("x STRING", "STRING", "sha2(x, 256)"),
    "sha384": ("x STRING", "STRING", "sha2(x, 384)"),
    "sha512": ("x STRING", "STRING", "sha2(x, 512)"),
    "digest": ("x STRING, method STRING", "BINARY", "unhex(CASE lower(method) WHEN 'md5' THEN md5(x) WHEN 'sha224' THEN sha2(x, 224) WHEN 'sha256' THEN sha2(x, 256) WHEN 'sha384' THEN sha2(x, 384) WHEN 'sha512' THEN sha2(x, 512) ELSE raise_error('digest: unknown method') END)"),
    "date_bin": ("w INTERVAL DAY TO SECOND, ts TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP'1970-01-01 00:00:00'", "TIMESTAMP", f"timestamp_micros(CAST(floor((unix_micros(ts) - unix_micros(origin)) / {_WIDTH}) AS BIGINT) * {_WIDTH} + unix_micros(origin))"),
    "datetrunc": ("part STRING, ts TIMESTAMP", "TIMESTAMP", "date_trunc(part, ts)"),
    "to_timestamp_seconds": ("x BIGINT", "TIMESTAMP", "timestamp_seconds(x)"),
    "to_timestamp_millis": ("x BIGINT", "TIMESTAMP", "timestamp_millis(x)"),
    "to_timestamp_micros": ("x BIGINT", "TIMESTAMP", "timestamp_micros(x)"),
    "regexp_match": ("x STRING, p STRING", "ARRAY<STRING>", f"CASE WHEN x RLIKE p THEN transform(sequence(least(1, {_GROUPS}), {_GROUPS}), g -> regexp_extract(x, p, g)) END"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size(a) <> size(b) THEN raise_error('cosine_distance: vectors have different lengths') WHEN {_SQUARE.format('a')} * {_SQUARE.format('b')} = 0 THEN double('NaN') ELSE (1 - aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (t, v) -> t + v) / sqrt({_SQUARE.format('a')} * {_SQUARE.format('b')})) / 2 END"),
    "array_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (p, q) -> (p - q) * (p - q)), 0D, (t, v) -> t + v))"),
    "json_get_str": ("x STRING, k STRING", "STRING", _AT),
    "json_get_int": ("x STRING, k STRING", "BIGINT", f"try_cast({_AT} AS BIGINT)"),
    "json_get_float": ("x STRING, k STRING", "DOUBLE", f"try_cast({_AT} AS DOUBLE)"),
    "json_get_bool": ("x STRING, k STRING", "BOOLEAN", f"try_cast({_AT} AS BOOLEAN)"),
    "json_contains": ("x STRING, k STRING", "BOOLEAN", "coalesce(array_contains(json_object_keys(x), k), false)"),
    "json_length": ("x STRING", "INT", "coalesce(json_array_length(x), size(json_object_keys(x)))"),
    "pg_regexp_replace": ("x STRING, p STRING, r STRING, flags STRING DEFAULT ''", "STRING", f"CASE WHEN contains(flags, 'g') THEN regexp_replace(x, {_PATTERN}, {_BY}) WHEN regexp_instr(x, {_PATTERN}) = 0 THEN x ELSE concat(substr(x, 1, regexp_instr(x, {_PATTERN}) - 1), regexp_replace(regexp_extract(x, {_PATTERN}, 0), {_PATTERN}, {_BY}), substr(x, regexp_instr(x, {_PATTERN}) + length(regexp_extract(x, {_PATTERN}, 0)))) END"),
    "pg_log": ("a DOUBLE, b DOUBLE DEFAULT CAST(NULL AS DOUBLE)", "DOUBLE", "CASE WHEN b IS NULL THEN log10(a) ELSE ln(b) / ln(a) END"),
    "pg_trunc": ("x DOUBLE, digits INT DEFAULT 0", "DOUBLE", "signum(x) * floor(abs(x) * pow(10, digits)) / pow(10, digits)"),
    "pg_chr": ("code INT", "STRING", "decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32')"),
    "pg_left": ("x STRING, n INT", "STRING", "substr(x, 1, CASE WHEN n < 0 THEN greatest(length(x) + n, 0) ELSE n END)"),
    "pg_right": ("x STRING, n INT", "STRING", "CASE WHEN n < 0 THEN substr(x, 1 - n) ELSE right(x, n) END"),
    "pg_substr": ("x STRING, place INT, n INT DEFAULT 2147483647", "STRING", "substr(x, greatest(place, 1), CASE WHEN n = 2147483647 THEN n ELSE greatest(place + n - greatest(place, 1), 0) END)"),
    "pg_initcap": ("x STRING", "STRING", r"array_join(transform(regexp_extract_all(lower(x), '([\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+)', 1), w -> concat(upper(substr(w, 1, 1)), substr(w, 2))), '')"),
}

#: How calls of names that Spark has with another meaning are written.
RENAMED = {"log": "pg_log(", "trunc": "pg_trunc(", "chr": "pg_chr(", "left": "pg_left(", "right": "pg_right(", "substr": "pg_substr(", "initcap": "pg_initcap(", "regexp_replace": "pg_regexp_replace(", "concat": "concat_ws('', ", "from_unixtime": "timestamp_seconds("}
_CALL = re.compile(rf"(?<![\w.])({'|'.join(RENAMED)})\(", re.I)


def register(spark: SparkSession) -> None:
    """Defines the functions in the session, once."""
    if not spark.catalog.functionExists("pg_initcap"):
        for name, (arguments, kind, body) in DEFINED.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def in_sql(text: str) -> str:
    """A text without quotes and comments, with calls written under the names that have PostgreSQL's meaning."""
    return _CALL.sub(lambda m: RENAMED[m[1].lower()], text)
