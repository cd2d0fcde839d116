"""Maps from half-open ranges to values as tables (start, stop, value), and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written

#: Rows of a range table that is broadcast for a lookup.
BROADCAST_ROWS = 1_000


def overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges that are empty or begin before one that starts earlier (or at the same place) has ended; none in a valid map."""
    running = Window.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)  # a range table is a manifest, small by nature
    return ranges.withColumn("_end", F.max("stop").over(running)).where("start >= stop OR _end > start").drop("_end")


def point_lookup(points: DataFrame, key: str, ranges: DataFrame, rows: int | None = None) -> DataFrame:
    """Each point with the value of the range that holds it; points in no range are left out, as are those with null.

    A range table of up to BROADCAST_ROWS rows (they are counted, or given) is broadcast. With a larger one, both sides are
    sorted together by key in ranges of about equal size, and each point takes the last start before it; what a range of
    keys begins with comes as one row from those before it.
    """
    if (ranges.count() if rows is None else rows) <= BROADCAST_ROWS:
        r = F.broadcast(ranges.select(F.col("start").alias("_start"), F.col("stop").alias("_stop"), "value"))
        return points.join(r, (F.col(key) >= F.col("_start")) & (F.col(key) < F.col("_stop"))).drop("_start", "_stop")
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = ranges.select(F.col("start").cast("bigint").alias("_key"), F.lit(0).alias("_kind"), F.struct("start", "stop", "value").alias("_range"), F.lit(None).cast(points.schema).alias("_point"))
    asked = points.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_key"), F.lit(1).alias("_kind"), F.lit(None).cast(held.schema["_range"].dataType).alias("_range"), F.struct(*points.columns).alias("_point"))
    both = written(held.union(asked).repartitionByRange(n, "_key", "_kind").withColumn("_part", F.spark_partition_id()), "lookup")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    carried = both.groupBy("_part").agg(F.max_by("_range", F.when(F.col("_kind") == 0, F.col("_key"))).alias("_last"))
    carried = carried.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    running = Window.partitionBy("_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_of", F.last("_range", ignorenulls=True).over(running)).where("_kind = 1")
    found = found.join(F.broadcast(carried), "_part").withColumn("_of", F.coalesce("_of", "_carry")).where("_key < _of.stop")  # as many rows as parts
    return found.select("_point.*", F.col("_of.value").alias("value"))


def overlapping(ranges: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    """The ranges that have a key in common with start (None: the least) to stop (exclusive; None: beyond the largest)."""
    out = ranges
    if start is not None:
        out = out.where(F.col("stop") > start)
    if stop is not None:
        out = out.where(F.col("start") < stop)
    return out.orderBy("start")


def exact_lookup(wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    return wanted.join(ranges, ["start", "stop"])


def with_range(ranges: DataFrame, start: int, stop: int, value) -> DataFrame:
    """The map with one range more; ValueError if it is empty or overlaps another."""
    if start >= stop or not overlapping(ranges, start, stop).isEmpty():
        raise ValueError("empty or overlapping range")
    return ranges.select("start", "stop", "value").union(ranges.sparkSession.createDataFrame([(start, stop, value)], ranges.select("start", "stop", "value").schema))


def without_range(ranges: DataFrame, start: int, stop: int) -> DataFrame:
    return ranges.where(~((F.col("start") == start) & (F.col("stop") == stop)))


def has_key(points: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """The points that a range of the map holds."""
    packed = points.select(F.struct(*points.columns).alias("_row"), F.col(key).alias("_at"))
    return point_lookup(packed, "_at", ranges.select("start", "stop", F.lit(1).alias("value"))).select("_row.*")


def common_files(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Files that both selections name, in order."""
    return a.intersect(b).orderBy(order)


def page_ranges(df: DataFrame, width: int) -> DataFrame:
    """(start, stop, value): ranges of width pages that hold rows, with the number of rows."""
    start: Column = (F.floor(F.col("page_id") / width) * width).cast("bigint")
    return df.groupBy(start.alias("start")).agg(F.count("*").alias("value")).select("start", (F.col("start") + width).alias("stop"), "value")
