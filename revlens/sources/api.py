"""Answers of a page API as tables, looked up by page, title or revision; and the dump's status file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import parse_iso, parse_plain
from ..operators.layout import chunked
from ..schema import BASE

PAGE = "struct<pageid: bigint, ns: int, title: string, missing: string, revisions: array<struct<revid: bigint, parentid: bigint, minor: string, user: string, userid: bigint, userhidden: string, timestamp: string, sha1: string, comment: string>>>"
ANSWER = f"batchcomplete string, query struct<pages: map<string, {PAGE}>, badrevids: map<string, struct<revid: bigint, missing: string>>>"
STATUS = "version string, jobs map<string, struct<status: string, updated: string, files: map<string, struct<size: bigint, url: string, md5: string, sha1: string>>>>"


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER).option("mode", "FAILFAST").option("multiLine", True).json(path)


def pages_of(answers: DataFrame) -> DataFrame:
    """A row for each page that is there (an answer may also name missing pages)."""
    pages = answers.select(F.explode(F.map_values("query.pages")).alias("p"))
    return pages.where("p.missing IS NULL AND p.pageid IS NOT NULL AND p.title IS NOT NULL").select("p.*")


def revisions_of(answers: DataFrame) -> DataFrame:
    """Base rows of all revisions in answers. Parent 0 and an empty comment are none; the model and format are an item's."""
    r = F.col("r")
    out = pages_of(answers).select("pageid", "ns", "title", F.explode("revisions").alias("r"))
    fields = {
        "entity_id": F.col("title"), "page_id": F.col("pageid"), "namespace": F.col("ns"), "redirect": F.lit(None).cast("string"), "revision_id": r["revid"], "parent_revision_id": F.nullif(r["parentid"], F.lit(0)), "timestamp": parse_iso(r["timestamp"]),
        "contributor": r["user"], "contributor_id": r["userid"], "is_minor": F.coalesce(r["minor"] == "", F.lit(False)), "comment": F.nullif(r["comment"], F.lit("")),
        "wikibase_model": F.lit("wikibase-item"), "wikibase_format": F.lit("application/json"), "sha1": r["sha1"],
    }
    return out.select(*[fields[c].alias(c) for c in BASE.names])


def look_up(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each wanted row (key, and pos for its place) with its answer, or nulls; in the order asked for."""
    return wanted.join(rows, key, "left").orderBy("pos")


def batches(wanted: DataFrame, key: str, size: int = 50) -> DataFrame:
    """What one request asks for."""
    return chunked(wanted, [key], size)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(version, job, status, updated) of a dump's jobs."""
    jobs = spark.read.schema(STATUS).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return jobs.select("version", F.explode("jobs").alias("job", "j")).select("version", "job", "j.status", parse_plain(F.col("j.updated")).alias("updated"), "j.files")


def dump_files(status: DataFrame, job: str) -> DataFrame:
    """(name, url, sha1, size) of a job; ValueError if some job isn't done."""
    if not status.where("status <> 'done'").isEmpty():
        raise ValueError("the dump isn't complete")
    return status.where(F.col("job") == job).select(F.explode("files").alias("name", "f")).select("name", "f.url", "f.sha1", "f.size")


def read_sites(rows: DataFrame) -> DataFrame:
    """(global_key, language, url) of the sites table, the dimension of site links."""
    return rows.select("global_key", "language", "url").dropDuplicates(["global_key"])
