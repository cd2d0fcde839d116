"""History analytics: growth, revisions per page, times between them, changes, and lifetimes of triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bin_label
from ..functions.time import days_ceil, days_floor, micros
from .delta import KEY
from .filters import in_years

Bins = list[tuple[int, int | None]]
PER_ENTITY: Bins = [(1, 2), (2, 10), (10, 100), (100, None)]
PER_REVISION: Bins = [(0, 1), (1, 2), (2, 10), (10, None)]
DAYS: Bins = [(0, 2), (2, 31), (31, 181), (181, 366), (366, None)]
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: Upper bounds (inclusive) of times between revisions; beyond the last is one bin more.
UP_TO = [SECOND, MINUTE, HOUR, DAY, 7 * DAY, 30 * DAY, 365 * DAY]


def _cumulative(counts: DataFrame, name: str, last: int) -> DataFrame:
    """Running sums over all years from the first that has a count to the last; a table of years is a few rows."""
    span = counts.agg(F.min("year").alias("first")).where("first IS NOT NULL").select(F.explode(F.sequence(F.col("first"), F.lit(last))).alias("year"))
    running = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return span.join(counts, "year", "left").select("year", F.sum(F.coalesce("n", F.lit(0))).over(running).cast("bigint").alias(name))


def entities_by_year(revisions: DataFrame, first: int = 2012, last: int = 2020) -> DataFrame:
    """(year, entities): pages by the year of their first revision (by id, not by time) among those in the years, cumulative."""
    started = in_years(revisions, first, last).groupBy("page_id").agg(F.min_by(F.year("timestamp"), "revision_id").alias("year"))
    return _cumulative(started.groupBy("year").agg(F.count("*").alias("n")), "entities", last)


def revisions_by_year(revisions: DataFrame, first: int = 2012, last: int = 2020) -> DataFrame:
    return _cumulative(in_years(revisions, first, last).groupBy(F.year("timestamp").alias("year")).agg(F.count("*").alias("n")), "revisions", last)


def totals(revisions: DataFrame, first: int = 2012, last: int = 2020) -> DataFrame:
    return in_years(revisions, first, last).agg(F.countDistinct("page_id").alias("entities"), F.count("*").alias("revisions"))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """(value, n)."""
    return df.groupBy(value.cast("bigint").alias("value")).agg(F.count("*").alias("n"))


def revisions_per_entity(revisions: DataFrame) -> DataFrame:
    return histogram(revisions.groupBy("page_id").agg(F.count("*").alias("k")), F.col("k"))


def binned(counts: DataFrame, bins: Bins, normalised: bool = True) -> DataFrame:
    """(bin, label, n, share) for each half-open bin, also empty ones. share: of all counts, in a bin or not; null without any."""
    which = F.coalesce(*[F.when((F.col("value") >= a) & (F.lit(True) if b is None else F.col("value") < b), F.lit(i)) for i, (a, b) in enumerate(bins)])
    sums = counts.groupBy(which.alias("bin")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    names = counts.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bins)], "bin int, low bigint, high bigint")
    out = names.join(sums, "bin", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))  # total is one row
    columns = ["bin", bin_label(F.col("low"), F.col("high")).alias("label"), "n"]
    return out.select(*columns, *([F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("share")] if normalised else []))


def time_between(revisions: DataFrame) -> DataFrame:
    """Revisions that have one before on their page, with the time since then (microseconds; negative where times go back)."""
    page = Window.partitionBy("page_id").orderBy("revision_id")
    return revisions.withColumn("_last", F.lag("timestamp").over(page)).where("_last IS NOT NULL").select("page_id", "revision_id", micros(F.col("_last"), F.col("timestamp")).alias("micros"), days_floor(F.col("_last"), F.col("timestamp")).alias("days"))


def time_between_days(revisions: DataFrame) -> DataFrame:
    return histogram(time_between(revisions), F.col("days"))


def time_between_bins(revisions: DataFrame) -> DataFrame:
    """(bin, n, share): by upper bounds; negative times are in no bin, and shares are of what is in one."""
    t = F.col("micros")
    which = F.when(t < 0, F.lit(None).cast("int"))
    for i, b in enumerate(UP_TO):
        which = which.when(t <= b, F.lit(i))
    sums = time_between(revisions).select(which.otherwise(F.lit(len(UP_TO))).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    every = sums.sparkSession.range(len(UP_TO) + 1).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.broadcast(sums.agg(F.sum("n").alias("total")))  # one row
    return every.crossJoin(total).select("bin", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("share"))


def delta_sizes(deltas: DataFrame) -> DataFrame:
    """(side, value, n): how many triples revisions add and delete."""
    return count_sizes(deltas.select(F.size("triple_additions").cast("bigint").alias("additions"), F.size("triple_deletions").cast("bigint").alias("deletions")))


def count_sizes(counts: DataFrame) -> DataFrame:
    """As delta_sizes(), of revisions with additions and deletions as numbers, see delta.counted()."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("value")) for s, c in (("add", "additions"), ("delete", "deletions"))])
    return counts.select(F.inline(sides)).groupBy("side", "value").agg(F.count("*").alias("n"))


def lifetimes(log: DataFrame) -> DataFrame:
    """For each triple of a page ever added: the times of its first addition and first deletion."""

    def first(op: str) -> Column:
        return F.min_by(F.when(F.col("op") == op, F.col("timestamp")), F.when(F.col("op") == op, F.col("revision_id")))

    return log.groupBy("page_id", *KEY).agg(first("add").alias("added"), first("delete").alias("deleted"), F.count_if(F.col("op") == "delete").alias("deletions"), F.count_if(F.col("op") == "add").alias("additions"))


def time_to_first_addition(revisions: DataFrame, log: DataFrame) -> DataFrame:
    """(value, n): days, rounded up, from a page's first revision to a triple's first addition."""
    start = revisions.groupBy("page_id").agg(F.min_by("timestamp", "revision_id").alias("started"))
    return histogram(lifetimes(log).where("added IS NOT NULL").join(start, "page_id"), days_ceil(F.col("started"), F.col("added")))


def time_to_first_deletion(log: DataFrame) -> DataFrame:
    """(value, n): days, rounded up, from a triple's first addition to its first deletion."""
    return histogram(lifetimes(log).where("added IS NOT NULL AND deleted IS NOT NULL"), days_ceil(F.col("added"), F.col("deleted")))


def deletions_per_triple(log: DataFrame, corrected: bool = False) -> DataFrame:
    """(value, n): triples by how often they are deleted. 0 counts all triples ever added; corrected: those never deleted."""
    lives = lifetimes(log).where("added IS NOT NULL")
    if corrected:
        return histogram(lives, F.col("deletions"))
    values = F.when(F.col("deletions") > 0, F.array(F.lit(0).cast("bigint"), F.col("deletions"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return histogram(lives.select(F.explode(values).alias("value")), F.col("value"))


QUANTILES = (0.01, 0.025, 0.25, 0.5, 0.75, 0.975, 0.99)


def statistics(counts: DataFrame) -> DataFrame:
    """One row of a histogram (value, n): mean, std, std_mean and quantiles (whole numbers).

    A quantile is the first value whose cumulative count reaches its share, averaged with the next value if it does so
    exactly, then cut to a whole number. std_mean: std over the root of the count less one.
    """
    v, w = F.col("value").cast("double"), F.col("n").cast("double")
    running = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # a histogram, small by nature
    total = F.broadcast(counts.agg(F.sum(w).alias("t"), (F.sum(v * w) / F.sum(w)).alias("mean")))  # one row
    rows = counts.withColumns({"cum": F.sum(w).over(running), "next": F.lead(v).over(Window.orderBy("value"))}).crossJoin(total)
    spread = F.sqrt(F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))) / F.first("t"))

    def quantile(p: float) -> Column:
        at = F.col("cum") - p * F.col("t")
        exact = F.when((F.abs(at) < 1e-9) & F.col("next").isNotNull(), (v + F.col("next")) / 2).otherwise(v)
        return F.min_by(exact, F.when(at >= -1e-9, v)).cast("bigint").alias("q" + str(p)[2:])

    return rows.agg(F.first("mean").alias("mean"), spread.alias("std"), (spread / F.sqrt(F.first("t") - 1)).alias("std_mean"), *[quantile(p) for p in QUANTILES])


def sizes(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes) of a file list."""
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
