"""The two layouts of one history: by page, and in revision order by month and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import EARLIEST
from ..plans.storage import written


def day_bucket(df: DataFrame, earliest: str = EARLIEST, ranges: int | None = None) -> DataFrame:
    """Rows with `bucket`: the day that is open when they arrive in order of revision_id.

    A row of an earlier day goes to the open day, a row of a later one opens its own: the running maximum of the days, at
    least `earliest`. It is taken in two steps: rows are range-partitioned by revision_id and written, each range has its
    running maximum, and the maxima of the ranges before it come as one row for each range.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, "revision_id").withColumn("_range", F.spark_partition_id()), "days")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = ranged.groupBy("_range").agg(F.max(F.to_date("timestamp")).alias("_last")).select("_range", F.max("_last").over(before).alias("_carry"))
    running = Window.partitionBy("_range").orderBy("revision_id").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_max", F.max(F.to_date("timestamp")).over(running)).join(F.broadcast(carried), "_range")
    return out.withColumn("bucket", F.greatest(F.col("_max"), F.col("_carry"), F.lit(earliest).cast("date"))).drop("_range", "_max", "_carry")


def month_manifest(bucketed: DataFrame, unit: str = "MM") -> DataFrame:
    """(bucket, start, stop, n_rows) for each month (or day, unit "DD") that has rows."""
    day = F.trunc("bucket", "MM") if unit == "MM" else F.col("bucket")
    return bucketed.groupBy(day.alias("bucket")).agg(F.min("revision_id").alias("start"), (F.max("revision_id") + 1).alias("stop"), F.count("*").alias("n_rows"))


def beyond(bucketed: DataFrame, last_month: str) -> DataFrame:
    """Rows that a history up to this month must not have."""
    return bucketed.where(F.trunc("bucket", "MM") > F.trunc(F.lit(last_month).cast("date"), "MM"))


def write_by_page(deltas: DataFrame, path: str, pages: int = 100_000, mode: str = "ignore") -> None:
    """A folder for each range of pages; in a file, rows by page and revision. An existing layout stays."""
    rows = deltas.withColumn("page_range", (F.floor(F.col("page_id") / pages) * pages).cast("bigint"))
    rows.repartitionByRange("page_id").sortWithinPartitions("page_range", "page_id", "revision_id").write.partitionBy("page_range").mode(mode).parquet(path)


def write_by_time(deltas: DataFrame, path: str, last_month: str | None = None, mode: str = "ignore") -> None:
    """Folders of months and days, by arrival (see day_bucket); in a file, rows by revision. ValueError on rows beyond last_month."""
    rows = day_bucket(deltas)
    if last_month is not None and not beyond(rows, last_month).isEmpty():
        raise ValueError(f"revisions beyond {last_month}")
    rows = rows.withColumns({"month": F.trunc("bucket", "MM"), "day": F.col("bucket")}).drop("bucket")
    rows.repartitionByRange("month", "day", "revision_id").sortWithinPartitions("month", "day", "revision_id").write.partitionBy("month", "day").mode(mode).parquet(path)


def manifest(df: DataFrame) -> DataFrame:
    """(file, min_page_id, max_page_id, min_revision_id, max_revision_id, n_rows) of a table's files."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("page_id").alias("min_page_id"), F.max("page_id").alias("max_page_id"), F.min("revision_id").alias("min_revision_id"), F.max("revision_id").alias("max_revision_id"), F.count("*").alias("n_rows"))


def chunked(df: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """(chunk, items): the values of the first column of order, in groups of size, as a client would ask for them.

    The global place is a range's offset and the place in it, so that no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.select(*order).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "chunks")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    nr = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_nr", nr).join(F.broadcast(offsets), "_range").withColumn("_nr", F.col("_nr") + F.col("_offset"))
    items = F.array_sort(F.collect_list(F.struct("_nr", order[0])))
    return placed.groupBy(F.floor(F.col("_nr") / size).alias("chunk")).agg(F.transform(items, lambda x: x[order[0]]).alias("items"))
