"""Sampling operators: distinct values by column, first rows, top rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_distinct(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``n`` rows that show each column's distinct values first (in order), then repeats; columns are paired by place.

    Each column's first values are a top-k of its own, so no task sees a whole column.
    """
    out = None
    for c in columns:
        distinct = df.select(c).distinct().select(F.lit(1).alias("__p"), F.col(c))
        padding = df.select(F.lit(2).alias("__p"), F.col(c)).orderBy(F.col(c).asc_nulls_last()).limit(n)
        first = distinct.orderBy(F.col(c).asc_nulls_last()).limit(n).unionByName(padding).orderBy("__p", F.col(c).asc_nulls_last()).limit(n)
        numbered = first.withColumn("__n", F.row_number().over(Window.orderBy("__p", F.col(c).asc_nulls_last()))).drop("__p")
        out = numbered if out is None else out.join(numbered, "__n", "full")
    return out.orderBy("__n").select(*columns)


def sample_first(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def order_terms(order_by: str) -> list[str]:
    """The terms of an order, parted at commas outside of parentheses and quotes."""
    terms, depth, quote = [""], 0, ""
    for c in re.sub(r"^\s*order\s+by\s+", "", order_by, flags=re.I):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c in "([") - (c in ")]")
        if c == "," and not depth and not quote:
            terms.append("")
        else:
            terms[-1] += c
    return terms


def sample_top(df: DataFrame, order_by: str, n: int) -> DataFrame:
    """The first ``n`` rows by a list of SQL expressions with optional ASC or DESC and NULLS FIRST or LAST; nulls are last, with DESC first."""
    order = []
    for term in order_terms(order_by):
        m = re.fullmatch(r"\s*(.+?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", term, re.I | re.S)
        column, down = F.expr(m[1]), (m[2] or "").lower() == "desc"
        first = m[3].lower() == "first" if m[3] else down
        order.append((column.desc_nulls_first() if first else column.desc_nulls_last()) if down else (column.asc_nulls_first() if first else column.asc_nulls_last()))
    return df.orderBy(*order).limit(n)
