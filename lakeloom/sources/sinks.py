"""Results as files or as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def write_files(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "append", by: list[str] | None = None) -> None:
    """Writes rows as files, in folders by the columns ``by``."""
    writer = df.write.mode(mode).format(file_format)
    if file_format == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def dual_write(df: DataFrame, *targets) -> int:
    """Gives the same rows to several writers, computing them once; returns the rows written over all."""
    kept = df.persist()
    try:
        return sum(target(kept) or 0 for target in targets)
    finally:
        kept.unpersist()


def json_lines(df: DataFrame) -> Iterator[str]:
    """The rows as JSON objects, a partition at a time on the driver."""
    for row in df.toJSON().toLocalIterator():
        yield row


def json_array(df: DataFrame) -> str:
    """A small result as one JSON array."""
    return "[" + ",".join(json_lines(df)) + "]"


def csv_text(df: DataFrame) -> str:
    """A small result as CSV with a header."""
    import io

    import pyarrow.csv as pc

    out = io.BytesIO()
    pc.write_csv(df.toArrow(), out)
    return out.getvalue().decode()
