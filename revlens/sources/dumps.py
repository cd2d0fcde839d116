"""XML dumps of pages with all their revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..functions.time import parse_iso
from ..schema import ENTITY, RAW, REVISION

#: Strings throughout: what is absent is null, and an element that closes itself is "".
PAGE = """
title string, ns int, id bigint, redirect struct<_title: string>,
revision array<struct<
    id: bigint, parentid: bigint, timestamp: string,
    contributor: struct<_deleted: string, username: string, id: bigint, ip: string>,
    minor: string, comment: struct<_VALUE: string, _deleted: string>, model: string, format: string, text: struct<_VALUE: string, _bytes: bigint, _deleted: string>, sha1: string>>
"""
SITE = "sitename string, dbname string, base string, generator string, case string, namespaces struct<namespace: array<struct<_key: int, _case: string, _VALUE: string>>>"
OPTIONS = {"valueTag": "_VALUE", "attributePrefix": "_", "mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def revisions_of(pages: DataFrame) -> DataFrame:
    """Pages (schema PAGE) as one row for each revision, with the page's fields on each.

    Contributors and redirects are given as they stand in the file, with entities; titles, comments and texts without.
    """
    r = F.col("r")
    out = pages.select("title", "ns", F.col("id").alias("page_id"), "redirect", F.explode("revision").alias("r"))
    fields = {
        "entity_id": F.col("title"), "namespace": F.col("ns"), "redirect": escape_xml(F.col("redirect._title")), "revision_id": r["id"], "parent_revision_id": r["parentid"], "timestamp": parse_iso(r["timestamp"]),
        "contributor": escape_xml(F.coalesce(r["contributor"]["username"], r["contributor"]["ip"])), "contributor_id": r["contributor"]["id"], "is_minor": r["minor"].isNotNull(), "comment": _filled(r["comment"]["_VALUE"]),
        "wikibase_model": r["model"], "wikibase_format": r["format"], "sha1": _filled(r["sha1"]), "text": _filled(r["text"]["_VALUE"]),
    }
    return out.select(*[(fields[c] if c in fields else F.col(c)).alias(c) for c in RAW.names])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Raw revisions of XML files (plain or compressed); a file that isn't well-formed fails."""
    return revisions_of(spark.read.format("xml").options(rowTag="page", **OPTIONS).schema(PAGE).load(path))


def parse_pages(xml: Column) -> Column:
    """A page element as a struct, for XML in a column."""
    return F.from_xml(xml, PAGE, OPTIONS)


def read_site(spark: SparkSession, path: str) -> DataFrame:
    """(site_name, db_name, base, generator, case, namespaces): one row of each file's header; a namespace without name is ""."""
    site = spark.read.format("xml").options(rowTag="siteinfo", **OPTIONS).schema(SITE).load(path)
    entries = F.transform("namespaces.namespace", lambda n: F.struct(n["_key"].alias("key"), F.coalesce(n["_VALUE"], F.lit("")).alias("value")))
    return site.select(F.col("sitename").alias("site_name"), F.col("dbname").alias("db_name"), "base", "generator", "case", F.map_from_entries(entries).alias("namespaces"))


def entity_metadata(df: DataFrame) -> DataFrame:
    return df.select(*ENTITY)


def revision_metadata(df: DataFrame) -> DataFrame:
    return df.select(*REVISION)
