"""Integrity checks: each gives the rows that break a rule, none where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import EARLIEST, months_between
from ..plans.storage import written
from .delta import KEY
from .ranges import overlaps


def page_order(df: DataFrame) -> DataFrame:
    """Revisions whose id is not above the one before in their page, in the stream's order (column nr)."""
    page = Window.partitionBy("page_id").orderBy("nr")
    return df.withColumn("before", F.lag("revision_id").over(page)).where("revision_id <= before")


def global_order(df: DataFrame, order: str) -> DataFrame:
    """Revisions whose id is not above the one before in the order of a column, over the whole table.

    Ranges of that order are compared inside, and at their edges by one row for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.select(order, "revision_id").repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()), "order")
    inside = ranged.withColumn("before", F.lag("revision_id").over(Window.partitionBy("_range").orderBy(order)))
    edges = ranged.groupBy("_range").agg(F.min_by("revision_id", order).alias("revision_id"), F.min(order).alias(order), F.max_by("revision_id", order).alias("_last"))
    edges = edges.withColumn("before", F.lag("_last").over(Window.orderBy("_range")))  # one row for each range
    broken = F.col("revision_id") <= F.col("before")
    return inside.where(broken).select(order, "revision_id", "before").union(edges.where(broken).select(order, "revision_id", "before"))


def range_order(ranges: DataFrame) -> DataFrame:
    return overlaps(ranges)


def month_cover(months: DataFrame, first: str, last: str) -> DataFrame:
    """(month, problem): months from first to last that are missing, and others that are there or are there twice."""
    expected = months.sparkSession.range(1).select(F.explode(months_between(F.trunc(F.lit(first).cast("date"), "MM"), F.lit(last).cast("date"))).alias("month"))
    seen = months.groupBy("month").agg(F.count("*").alias("n"))
    both = expected.withColumn("due", F.lit(True)).join(seen, "month", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "twice")
    return both.select("month", problem.alias("problem")).where("problem IS NOT NULL")


def day_cover(days: DataFrame, month: str, last: str, earliest: str = EARLIEST) -> DataFrame:
    """Days (column day) of a month outside of earliest to the day after last, or outside of the month."""
    d = F.col("day")
    inside = (F.trunc(d, "MM") == F.trunc(F.lit(month).cast("date"), "MM")) & (d >= F.lit(earliest).cast("date")) & (d <= F.date_add(F.lit(last).cast("date"), 1))
    return days.where(~inside)


def ranges_within(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Inner ranges (start, stop) that are not within the outer range of the same key."""
    o = outer.select(key, F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    return inner.join(o, key, "left").where("_start IS NULL OR start < _start OR stop > _stop").drop("_start", "_stop")


def pages_in_files(df: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Pages outside of the range that their file's name gives."""
    return df.where(~F.col("page_id").between(F.col(low), F.col(high)))


def same_counts(paths: dict[str, DataFrame]) -> DataFrame:
    """(path, revisions, pages) of each way to the same rows."""
    counts = [df.agg(F.lit(name).alias("path"), F.count("*").alias("revisions"), F.countDistinct("page_id").alias("pages")).select("path", "revisions", "pages") for name, df in paths.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def both_added_and_deleted(log: DataFrame) -> DataFrame:
    """Triples that one revision adds and deletes."""
    return log.groupBy("page_id", "revision_id", *KEY).agg(F.countDistinct("op").alias("ops")).where("ops > 1")


def deleted_before_added(log: DataFrame) -> DataFrame:
    """Deletions that no addition of the triple to the page comes before."""
    order = Window.partitionBy("page_id", *KEY).orderBy("revision_id")
    return log.withColumn("_last", F.lag("op").over(order)).where("op = 'delete' AND (_last IS NULL OR _last = 'delete')").drop("_last")
