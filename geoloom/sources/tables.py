"""Time-series cubes and the tabular sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_CLOUD = 20.0


def cube_filter(df: DataFrame, start: str, end: str, bands: Iterable | None = None, max_cloud: float | None = MAX_CLOUD, box: tuple[float, float, float, float] | None = None, date: str = "acq_date", x: str = "x", y: str = "y") -> DataFrame:
    """Acquisitions of [start, end], of the given bands, at most ``max_cloud`` cloudy, inside a box
    (left, bottom, right, top).  Plain comparisons, so Parquet readers prune by them."""
    keep: Column = (F.col(date) >= F.lit(start).cast(df.schema[date].dataType)) & (F.col(date) <= F.lit(end).cast(df.schema[date].dataType))
    if bands is not None:
        keep &= F.col("band").isin(*bands)
    if max_cloud is not None:
        keep &= F.col("cloud_pct") <= max_cloud
    if box is not None:
        left, bottom, right, top = box
        keep &= (F.col(x) >= left) & (F.col(x) <= right) & (F.col(y) >= bottom) & (F.col(y) <= top)
    return df.where(keep)


def read_cube(spark: SparkSession, path: str, start: str, end: str, **limits) -> DataFrame:
    return cube_filter(spark.read.parquet(path), start, end, **limits)


def write_composite(composite: DataFrame, path: str, *partition: str) -> None:
    composite.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_events(events: DataFrame, path: str, keys: tuple[str, ...] = ("row", "col")) -> None:
    """CSV with a header, sorted by cell: changed cells only, so one file."""
    events.orderBy(*keys).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Scores, reports or a history as JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def report_lines(report: DataFrame) -> DataFrame:
    """A report as text lines, four digits."""
    return report.select(F.format_string("%s precision %.4f recall %.4f f1 %.4f support %d", "name", "precision", "recall", "f1", "support").alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_lines(report).coalesce(1).write.mode("overwrite").text(path)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df`` whose rows are checked as they are read; a row that fails stops the job with the message."""
    return df.where(F.assert_true(condition, F.lit(message)).isNull())
