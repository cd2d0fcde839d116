"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, written

#: Weights of the sources in the query and the pipeline; any other source has weight 1.
WEIGHTS = {"src0": 6.0, "src1": 2.0, "src2": 0.5}
BUDGET = 0.8
SEED = "mix-1"
WORD = r"[^ \t\n\r\f\x0B]+"


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """The place of a document in its source's shuffled order."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def schedule(docs: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float = BUDGET, seed: str = SEED, default_weight: float = 1.0) -> DataFrame:
    """(position, source, doc_id, tokens, finish, total): the documents sent before the budget is spent, in order.

    The documents of a source are shuffled (by MD5 of seed and doc_id). A document's virtual finish time is the source's
    tokens up to and with it, divided by the source's weight. Documents go out by finish time (ties: source, shuffle key,
    doc_id) as long as the running total is within the budget, a share of all tokens. Tokens are white-space words. A
    source that runs out leaves its share to the others.

    Rows of one source with the same doc_id go out or stay together and make one row; null in source is a source named
    "", null in doc_id one document of its source. A null or empty text has 0 tokens, and goes out with the row before
    it. An empty table gives an empty result. Other columns are not read. Weights must be positive (else ValueError).

    Running sums are in two steps (sums of buckets of the key, then sums in a bucket), so that no source, however hot,
    is one task's work; the global order is a range sort.
    """
    if min([default_weight, *weights.values()]) <= 0:
        raise ValueError("weights must be positive")
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    one = docs.select(source.alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("tokens"))
    one = one.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"))
    one = written(one.select("*", shuffle_key(F.col("doc_id"), seed).alias("key")), "mixing").withColumn("bucket", F.substring("key", 1, 3))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = one.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.lit(default_weight)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    timed = one.withColumn("within", F.sum("tokens").over(within)).join(starts, ["source", "bucket"])
    timed = timed.select("source", "doc_id", "tokens", "key", ((F.col("start") + F.col("within")).cast("double") / weight).alias("finish"))

    order = ["finish", "source", "key", "doc_id"]
    ranged = written(timed.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "mixing")
    sums = ranged.groupBy("range").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for c, a in (("n", "start"), ("rows", "skipped"))])
    most = sums.sparkSession.createDataFrame([(float(budget),)], "share double").crossJoin(one.agg(F.sum("tokens").alias("all"))).select(F.floor(F.col("share") * F.col("all")).alias("most"))
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queue = ranged.select("*", F.sum("tokens").over(running).alias("sum"), F.row_number().over(Window.partitionBy("range").orderBy(*order)).alias("nr"))
    queue = queue.join(F.broadcast(sums), "range").crossJoin(F.broadcast(most)).withColumn("total", F.col("start") + F.col("sum")).where("total <= most")  # as many rows as ranges; one row
    return queue.select((F.col("skipped") + F.col("nr")).alias("position"), "source", "doc_id", "tokens", "finish", "total", "key")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that schedule() sends, all columns kept.

    What is sent of a source is a prefix of its shuffled order, so that one key for each source, joined to the documents,
    is enough; the texts are not shuffled.
    """
    name, last, key = (fresh(docs, c) for c in ("mix_source", "mix_last", "mix_key"))
    ends = schedule(docs, **parameters).groupBy("source").agg(F.max("key").alias(last)).withColumnRenamed("source", name)
    ends = written(ends, "mixing")  # so that its size is known to the optimizer, which broadcasts it if small
    keyed = docs.withColumn(key, shuffle_key(F.col("doc_id"), parameters.get("seed", SEED)))
    sent = keyed.join(ends, (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(name)) & (F.col(key) <= F.col(last)))
    return sent.select(*docs.columns)


SQL = rf"""
WITH one AS (
    SELECT coalesce(source, '') AS source, doc_id, sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0)) AS tokens,
           md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
    FROM documents GROUP BY ALL
), timed AS (
    SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE)
           / CASE source {' '.join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in WEIGHTS.items())} ELSE 1 END AS finish
    FROM one
), queue AS (
    SELECT *, row_number() OVER o AS position, sum(tokens) OVER o AS total
    FROM timed WINDOW o AS (ORDER BY finish, source, key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
)
SELECT CAST(position AS BIGINT) AS position, source, doc_id, CAST(tokens AS BIGINT) AS tokens, finish, CAST(total AS BIGINT) AS total, key
FROM queue WHERE total <= (SELECT floor(CAST({BUDGET} AS DOUBLE) * sum(tokens)) FROM one)
"""
