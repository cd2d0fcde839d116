"""Histories as JSON lines: triples are arrays of three strings, times have a zone, nulls are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JSON_DELTA, JSON_OPTIONS, from_arrays, to_arrays

SIDES = ("triple_deletions", "triple_additions")


def read_deltas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Revisions with deletions and additions; a line that isn't valid fails."""
    df = spark.read.schema(JSON_DELTA).option("mode", "FAILFAST").options(**JSON_OPTIONS).json(path)
    return df.withColumns({c: from_arrays(F.col(c)) for c in SIDES})


def as_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as a JSON object."""
    names = columns or df.columns
    return F.to_json(F.struct(*[to_arrays(F.col(c)).alias(c) if c in SIDES else F.col(c) for c in names]), JSON_OPTIONS)


def write_deltas(df: DataFrame, path: str, mode: str = "ignore") -> None:
    df.withColumns({c: to_arrays(F.col(c)) for c in SIDES}).write.mode(mode).options(**JSON_OPTIONS).option("compression", "gzip").json(path)


def files_in_range(files: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Files (path, low, high) whose range, both ends in it, meets low to high."""
    out = files
    if low is not None:
        out = out.where(F.col("high") >= low)
    return out.where(F.col("low") <= high) if high is not None else out
