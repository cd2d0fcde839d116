"""Range predicates over revisions, and the prefix scan."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utc(t: datetime | None) -> datetime | None:
    """The time in UTC, which times without zone are in already."""
    return t if t is None else t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def between(column: str, low, high) -> Column:
    """Inclusive; None is open. 0 is a bound like any other."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= F.lit(low))
    if high is not None:
        out = out & (F.col(column) <= F.lit(high))
    return out


def select_revisions(df: DataFrame, *, page_id: int | None = None, min_page_id: int | None = None, max_page_id: int | None = None, min_revision_id: int | None = None, max_revision_id: int | None = None, min_timestamp: datetime | None = None, max_timestamp: datetime | None = None) -> DataFrame:
    """The rows that meet all predicates. One page excludes a range of pages (ValueError); an unknown page gives no rows."""
    if page_id is not None and (min_page_id is not None or max_page_id is not None):
        raise ValueError("either a page or a range of pages")
    out = df.where(between("revision_id", min_revision_id, max_revision_id) & between("timestamp", utc(min_timestamp), utc(max_timestamp)))
    return out.where(F.col("page_id") == page_id) if page_id is not None else out.where(between("page_id", min_page_id, max_page_id))


def prefix_scan(df: DataFrame, part: str, column: str, low, high) -> DataFrame:
    """As a reader that stops, in each part, at the first row beyond high: rows from there on are out, in range or not.

    Rows below low are passed over and don't stop it. Parts are read in the order of revision_id.
    """
    over = F.when(F.col(column).isNotNull() & (F.col(column) > F.lit(high)), 1).otherwise(0) if high is not None else F.lit(0)
    if low is not None:
        over = F.when(F.col(column) < F.lit(low), 0).otherwise(over)
    running = Window.partitionBy(part).orderBy("revision_id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_over", F.max(over).over(running)).where("_over = 0").drop("_over").where(between(column, low, high))


def in_years(df: DataFrame, first: int = 2012, last: int = 2020) -> DataFrame:
    """Rows of these years, by bounds that reach the scan."""
    return df.where((F.col("timestamp") >= F.lit(datetime(first, 1, 1)).cast(df.schema["timestamp"].dataType)) & (F.col("timestamp") < F.lit(datetime(last + 1, 1, 1)).cast(df.schema["timestamp"].dataType)))
