"""From raw documents to packed windows: each stage reads all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import line_dedup, mixing, packing, quality, simhash
from revlens.llm.common import fresh_dir, table

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality.keep_within_limits(docs)),
    ("line dedup", lambda spark, docs, sf_dir: line_dedup.drop_repeated_lines(docs)),
    ("near dedup", lambda spark, docs, sf_dir: simhash.drop_near_duplicates(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: Robust covariances, graph search and least squares are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage returns is written to the shared folder and read again as the next one's documents.

    Nulls, empty and long texts, ties and repeated rows are treated as the stages' docstrings say: the first drops texts
    without a word, the second makes repeated rows one, and rows without doc_id stay documents throughout. All columns of
    documents, further ones too, pass to the last stage. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
