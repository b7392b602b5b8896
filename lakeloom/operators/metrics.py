"""Percentiles from histograms of cumulative buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_counts(df: DataFrame, column: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts (le, n) of values up to each bound, the last bound being infinite; one aggregate."""
    edges = [*bounds, float("inf")]
    counts = F.array(*[F.struct(F.lit(b).alias("le"), F.count(F.when(F.col(column) <= b, 1)).alias("n")) for b in edges])
    return df.groupBy(*(by or [])).agg(counts.alias("buckets"))


def percentile(buckets: Column, p: float) -> Column:
    """The p-th fraction, interpolated in its bucket; the last finite bound where it lies beyond it, null without values.

    ``buckets`` is an array of (le, n) with rising bounds and cumulative counts.
    """
    total = F.element_at(buckets, -1)["n"]
    rank = total * p
    start = F.struct(F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("value"))

    def step(state: Column, b: Column) -> Column:
        inside = (b["n"] - state["before"]).cast("double")
        share = F.when(inside > 0, (rank - state["before"]) / inside).otherwise(0.0)
        here = F.when(b["le"] == float("inf"), state["low"]).otherwise(state["low"] + (b["le"] - state["low"]) * share)
        value = F.when(state["value"].isNull() & (b["n"] >= rank), here).otherwise(state["value"])
        return F.struct(F.when(b["le"] == float("inf"), state["low"]).otherwise(b["le"]).alias("low"), b["n"].alias("before"), value.alias("value"))

    return F.when(total > 0, F.aggregate(buckets, start, step, lambda s: s["value"]))
