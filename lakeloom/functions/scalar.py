"""Scalar functions with PostgreSQL semantics where Spark's namesakes differ.

Functions that agree (abs, sin, lower, md5, coalesce, greatest, least, ...) are used
as they are in ``pyspark.sql.functions`` and in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(c: Column | str) -> Column:
    """Ascending with nulls last, PostgreSQL's default."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending with nulls first, PostgreSQL's default."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def trunc(x: Column, digits: int = 0) -> Column:
    """Cuts a number off towards zero after ``digits`` decimals."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def log(x: Column, base: float | None = None) -> Column:
    """Base 10 with one argument."""
    return F.log10(x) if base is None else F.log(base, x)


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def concat(*parts: Column) -> Column:
    """Leaves nulls out."""
    return F.concat_ws("", *parts)


def chr_(code: Column) -> Column:
    """The character of any code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def digest(x: Column, method: str) -> Column:
    """md5, sha224, sha256, sha384 or sha512 as bytes."""
    return F.unhex(F.md5(x) if method == "md5" else F.sha2(x, int(method.removeprefix("sha"))))


def from_unixtime(x: Column) -> Column:
    return F.timestamp_seconds(x)


def left(x: Column, n: int) -> Column:
    """The first n characters; a negative n leaves out the last -n."""
    return F.substr(x, F.lit(1), F.greatest(F.length(x) + n, F.lit(0)) if n < 0 else F.lit(n))


def right(x: Column, n: int) -> Column:
    """The last n characters; a negative n leaves out the first -n."""
    return F.substr(x, F.lit(1 - n)) if n < 0 else F.right(x, F.lit(n))


def substr(x: Column, start: int, length: int | None = None) -> Column:
    """Counts from 1; places before the first count against the length."""
    if length is None:
        return F.substr(x, F.lit(max(start, 1)))
    end = start + length
    return F.substr(x, F.lit(max(start, 1)), F.lit(max(0, end - max(start, 1))))


def strpos(x: Column, part: str) -> Column:
    return F.locate(part, x)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def initcap(x: Column) -> Column:
    """Upper case after any character that is no letter or digit."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


def regexp_match(x: Column, pattern: str) -> Column:
    """The first match's groups (the whole match without groups) as an array; null without a match."""
    groups = re.compile(pattern).groups
    found = F.array(*[F.regexp_extract(x, pattern, g) for g in (range(1, groups + 1) if groups else (0,))])
    return F.when(F.rlike(x, F.lit(pattern)), found)


def regexp_replace(x: Column, pattern: str, by: str, flags: str = "") -> Column:
    r"""Replaces the first match, or all with the flag g; ``by`` refers to groups as \1."""
    by = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
    inner = "(?i)" + pattern if "i" in flags else pattern
    if "g" in flags:
        return F.regexp_replace(x, inner, by)
    whole = "(?s)" + ("(?i)" if "i" in flags else "") + f"^(.*?)(?:{pattern})"
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", by)
    return F.regexp_replace(x, whole, "$1" + shifted)


def date_bin(width_us: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin of ``width_us`` microseconds that ``ts`` (without zone) is in."""
    start = F.unix_micros(F.to_timestamp(F.lit(origin)))
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(F.floor((us - start) / width_us) * width_us + start).cast("timestamp_ntz")


def to_timestamp_millis(x: Column) -> Column:
    return F.timestamp_millis(x)


def arrow_typeof(x: Column) -> Column:
    """The type's name in the Arrow vocabulary."""
    names = {"bigint": "Int64", "int": "Int32", "smallint": "Int16", "tinyint": "Int8", "double": "Float64", "float": "Float32", "string": "Utf8", "boolean": "Boolean", "binary": "Binary", "date": "Date32", "timestamp_ntz": "Timestamp(Microsecond, None)", "timestamp": 'Timestamp(Microsecond, Some("UTC"))', "void": "Null"}
    name = F.typeof(x)
    out = name
    for spark, arrow in names.items():
        out = F.when(name == spark, arrow).otherwise(out)
    return out


# ---- JSON text


def json_path(*keys: str | int) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def json_get(x: Column, *keys: str | int) -> Column:
    """``->``: the value at the keys, as a variant; null where there is none."""
    return F.try_variant_get(F.try_parse_json(x), json_path(*keys), "variant")


def json_get_str(x: Column, *keys: str | int) -> Column:
    """``->>``: the value at the keys as text."""
    return F.get_json_object(x, json_path(*keys))


def json_get_int(x: Column, *keys: str | int) -> Column:
    return F.try_variant_get(F.try_parse_json(x), json_path(*keys), "bigint")


def json_get_float(x: Column, *keys: str | int) -> Column:
    return F.try_variant_get(F.try_parse_json(x), json_path(*keys), "double")


def json_get_bool(x: Column, *keys: str | int) -> Column:
    return F.try_variant_get(F.try_parse_json(x), json_path(*keys), "boolean")


def json_contains(x: Column, key: str) -> Column:
    """``?``: whether the object has the key."""
    return F.coalesce(F.array_contains(F.json_object_keys(x), key), F.lit(False))


def json_length(x: Column) -> Column:
    """Entries of an array or keys of an object; null for anything else."""
    return F.coalesce(F.json_array_length(x), F.size(F.when(F.json_object_keys(x).isNotNull(), F.json_object_keys(x))))
