"""The typed rows of a revision history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = ["entity_id", "page_id", "namespace", "redirect"]
REVISION = ["revision_id", "parent_revision_id", "timestamp", "contributor", "contributor_id", "is_minor", "comment", "wikibase_model", "wikibase_format", "sha1"]

TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "predicate", "object_")])
BASE = T.StructType([
    T.StructField("entity_id", T.StringType(), False), T.StructField("page_id", T.LongType(), False), T.StructField("namespace", T.IntegerType(), False), T.StructField("redirect", T.StringType()),
    T.StructField("revision_id", T.LongType(), False), T.StructField("parent_revision_id", T.LongType()), T.StructField("timestamp", T.TimestampType(), False), T.StructField("contributor", T.StringType()),
    T.StructField("contributor_id", T.LongType()), T.StructField("is_minor", T.BooleanType(), False), T.StructField("comment", T.StringType()), T.StructField("wikibase_model", T.StringType(), False),
    T.StructField("wikibase_format", T.StringType(), False), T.StructField("sha1", T.StringType()),
])
RAW = T.StructType([*BASE, T.StructField("text", T.StringType())])
STATE = T.StructType([*BASE, T.StructField("triples", T.ArrayType(TRIPLE))])
DELTA = T.StructType([*BASE, *(T.StructField(c, T.ArrayType(TRIPLE)) for c in ("triple_deletions", "triple_additions"))])

#: A triple is an array of three strings in JSON.
JSON_TRIPLES = T.ArrayType(T.ArrayType(T.StringType()))
JSON_DELTA = T.StructType([*BASE, *(T.StructField(c, JSON_TRIPLES) for c in ("triple_deletions", "triple_additions"))])
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx", "ignoreNullFields": "false"}


def to_arrays(triples: Column) -> Column:
    return F.transform(triples, lambda t: F.array(t["subject"], t["predicate"], t["object_"]))


def from_arrays(triples: Column) -> Column:
    return F.transform(triples, lambda t: F.struct(t[0].alias("subject"), t[1].alias("predicate"), t[2].alias("object_")))
