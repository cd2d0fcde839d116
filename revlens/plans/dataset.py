"""A history in its two layouts, and the choice between them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delta import edges, flattened, gathered
from ..operators.filters import select_revisions, utc
from ..operators.layout import write_by_page, write_by_time
from ..operators.rdf import convert
from ..sources.dumps import read_dump
from .storage import written


@dataclass
class Dataset:
    """by_page: sorted in ranges of pages; by_time: in folders of months and days, in order of revisions."""

    by_page: DataFrame
    by_time: DataFrame
    version: str = ""
    pages: int = 100_000

    def revisions(self, *, page_id: int | None = None, min_page_id: int | None = None, max_page_id: int | None = None, min_revision_id: int | None = None, max_revision_id: int | None = None, min_timestamp: datetime | None = None, max_timestamp: datetime | None = None) -> DataFrame:
        """The revisions that meet all predicates, exactly; all bounds are inclusive.

        Predicates on pages read the layout by page, and only its folders in question; others the one by time. There, a
        row is never in a month before its own, so that a least time prunes months; a greatest one doesn't, as late rows
        are in later months.
        """
        predicates = dict(page_id=page_id, min_page_id=min_page_id, max_page_id=max_page_id, min_revision_id=min_revision_id, max_revision_id=max_revision_id, min_timestamp=min_timestamp, max_timestamp=max_timestamp)
        low, high = (page_id, page_id) if page_id is not None else (min_page_id, max_page_id)
        if low is not None or high is not None:
            df = self.by_page
            if "page_range" in df.columns:
                width = self.pages
                df = df.where((F.col("page_range") >= low // width * width) if low is not None else F.lit(True)).where((F.col("page_range") <= high) if high is not None else F.lit(True)).drop("page_range")
        else:
            df = self.by_time
            if "month" in df.columns:
                if min_timestamp is not None:
                    df = df.where(F.col("month") >= F.lit(utc(min_timestamp).date().replace(day=1)))
                df = df.drop("month", "day")
        return select_revisions(df, **predicates)

    def in_order(self, **predicates) -> DataFrame:
        """As revisions(), by page and revision on the page route, by revision on the other."""
        by_page = any(predicates.get(k) is not None for k in ("page_id", "min_page_id", "max_page_id"))
        return self.revisions(**predicates).orderBy(*(["page_id"] if by_page else []), "revision_id")

    def page_ids(self) -> DataFrame:
        return self.by_page.select("page_id").distinct().orderBy("page_id")

    def month(self, first_day: str) -> DataFrame:
        return self.by_time.where(F.col("month") == F.lit(first_day).cast("date"))


class Engine:
    """Builds and loads histories under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, dump: str, version: str, last_month: str | None = None, sites: Column | None = None, pages: int = 100_000) -> Dataset:
        """From XML dumps to both layouts; what is there already stays. Dumps are read and converted once, into the shared folder."""
        by_page = f"{self.folder}/{version}/by_page"
        states = written(convert(read_dump(self.spark, dump), sites).where(F.col("triples").isNotNull()), "states")
        revisions = states.drop("triples")
        write_by_page(gathered(revisions, edges(revisions, flattened(states))), by_page, pages)
        write_by_time(self.spark.read.parquet(by_page).drop("page_range"), f"{self.folder}/{version}/by_time", last_month)
        return self.load(version, pages)

    def load(self, version: str, pages: int = 100_000) -> Dataset:
        read = self.spark.read.parquet
        return Dataset(read(f"{self.folder}/{version}/by_page"), read(f"{self.folder}/{version}/by_time"), version, pages)
