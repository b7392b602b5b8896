"""The advertised scalar functions by name, as builders of columns.

``call("lpad", col, 5, "*")`` gives the column; names that mean the same in Spark
map to it, the others to :mod:`lakeloom.functions.scalar`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import scalar as S
from lakeloom.functions.vectors import array_distance, cosine_distance

#: Advertised functions that mean the same in Spark.
_SAME = (
    "abs", "acos", "asin", "atan", "atan2", "cos", "exp", "ln", "log10", "log2", "pow", "power", "round", "signum", "sin", "sqrt", "tan",
    "ascii", "bit_length", "btrim", "char_length", "character_length", "concat_ws", "length", "lower", "lpad", "ltrim", "md5", "octet_length",
    "repeat", "replace", "reverse", "rpad", "rtrim", "split_part", "translate", "trim", "upper",
    "current_date", "current_time", "date_part", "date_trunc", "datepart", "now", "to_timestamp",
    "array", "struct", "greatest", "least", "coalesce", "nullif", "array_contains",
)

FUNCTIONS: dict[str, Callable[..., Column]] = {name: getattr(F, name) for name in _SAME} | {
    "ceil": S.ceil,
    "floor": S.floor,
    "log": S.log,
    "trunc": S.trunc,
    "arrow_typeof": S.arrow_typeof,
    "chr": S.chr_,
    "concat": S.concat,
    "digest": S.digest,
    "from_unixtime": S.from_unixtime,
    "initcap": S.initcap,
    "left": S.left,
    "right": S.right,
    "substr": S.substr,
    "random": lambda: F.rand(),
    "regexp_match": S.regexp_match,
    "regexp_replace": S.regexp_replace,
    "sha224": lambda x: F.sha2(x, 224),
    "sha256": lambda x: F.sha2(x, 256),
    "sha384": lambda x: F.sha2(x, 384),
    "sha512": lambda x: F.sha2(x, 512),
    "starts_with": F.startswith,
    "strpos": S.strpos,
    "to_hex": S.to_hex,
    "uuid": lambda: F.expr("uuid()"),
    "date_bin": S.date_bin,
    "datetrunc": F.date_trunc,
    "to_timestamp_micros": F.timestamp_micros,
    "to_timestamp_millis": S.to_timestamp_millis,
    "to_timestamp_seconds": F.timestamp_seconds,
    "cosine_distance": cosine_distance,
    "array_distance": array_distance,
    "json_get": S.json_get,
    "json_get_str": S.json_get_str,
    "json_get_int": S.json_get_int,
    "json_get_float": S.json_get_float,
    "json_get_bool": S.json_get_bool,
    "json_contains": S.json_contains,
    "json_length": S.json_length,
}


def call(name: str, *args) -> Column:
    """The function of that name (any case) of the arguments; an error for unknown names."""
    found = FUNCTIONS.get(name.lower())
    if found is None:
        raise ValueError(f"there is no function {name}")
    return found(*args)
