"""The delta transform on a stream: the last state of each page is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.delta import ops, with_changes

OUT = "page_id bigint, revision_id bigint, op string, subject string, predicate string, object_ string"
STATE = "revision_id bigint, subjects array<string>, predicates array<string>, objects array<string>"


def _key(t: tuple[str, str, str]) -> tuple[str, str, str]:
    return (t[0], t[1], "_:") if t[2].startswith("_:") else t


def _step(page: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, subjects, predicates, objects = state.get if state.exists else (-1, [], [], [])
    now = {_key(t): t for t in zip(subjects, predicates, objects)}
    events = []
    rows = pd.concat(list(frames)).sort_values("revision_id", kind="stable")
    for revision_id, triples in zip(rows["revision_id"], rows["triples"]):
        if revision_id <= last:
            events.append((page[0], revision_id, "late", None, None, None))
            continue
        if triples is None:
            continue
        new: dict = {}
        for t in triples:
            new.setdefault(_key((t["subject"], t["predicate"], t["object_"])), (t["subject"], t["predicate"], t["object_"]))
        events += [(page[0], revision_id, op, *t) for op, a, b in (("delete", now, new), ("add", new, now)) for t in sorted(v for k, v in a.items() if k not in b)]
        now, last = new, revision_id
    state.update((last, *([t[i] for t in now.values()] for i in range(3))))
    yield pd.DataFrame(events, columns=["page_id", "revision_id", "op", "subject", "predicate", "object_"])


def stream_edges(states: DataFrame) -> DataFrame:
    """A stream of (page_id, revision_id, triples) to its edge log (op: add, delete).

    Rows of one batch are taken in order of revision_id; a row not above the page's last revision gives one row "late" and
    changes nothing. Rows with null in triples are left out.
    """
    rows = states.select("page_id", "revision_id", F.col("triples"))
    return rows.groupBy("page_id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start(states: DataFrame, to: str) -> StreamingQuery:
    """Starts a query that takes all of a stream of (page_id, revision_id, triples) and writes its edge log below to; see log().

    Rows mean the same as for stream_edges(), which is for pages that fit a Python worker; here a batch is one transform
    as of delta.with_changes(). Of rows of one batch with the same page and revision_id, one with triples counts, further
    ones with triples are late. A batch also writes the last state of each of its pages, from where the next ones go on;
    so that states are neither all written again nor read from many folders, those of 2, 4, 8, ... batches are merged in
    to + "-state". A batch that is repeated after a failure overwrites what it had written.
    """
    return states.writeStream.foreachBatch(lambda rows, n: _batch(rows, n, to)).option("checkpointLocation", to + "-progress").trigger(availableNow=True).start()


def log(spark: SparkSession, to: str) -> DataFrame:
    """The edge log (op: add, delete, late) of all batches."""
    return spark.read.schema(OUT).option("recursiveFileLookup", True).parquet(to).where(F.col("op").isin("add", "delete", "late"))


def _batch(rows: DataFrame, number: int, to: str) -> None:
    spark = rows.sparkSession
    rows = rows.select("page_id", "revision_id", "triples")
    state = _states(spark, to, _runs(number)) if number else None
    if state is None:
        rows = rows.withColumn("_last", F.lit(-1))
    else:
        last = state.where("op = 'last'").select("page_id", F.col("revision_id").alias("_last"))
        rows = rows.join(last, "page_id", "left").withColumn("_last", F.coalesce("_last", F.lit(-1)))
    old = F.col("revision_id") <= F.col("_last")
    rows = rows.where(old | F.col("triples").isNotNull())
    page = Window.partitionBy("page_id").orderBy("revision_id")
    found = rows.withColumn("_late", old | F.coalesce(F.lag("revision_id").over(page) == F.col("revision_id"), F.lit(False)))
    found = found.withColumns({
        "nr": F.count_if(~F.col("_late")).over(page.rowsBetween(Window.unboundedPreceding, 0)),
        "next_id": F.expr("lead(CASE WHEN NOT _late THEN revision_id END) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY revision_id)"),
    })
    # a late row, and one more row for a page's last revision, go along without a triple
    none = F.expr("CAST(array(NULL) AS array<struct<subject: string, predicate: string, object_: string>>)")
    items = F.when(F.col("_late"), none).when(F.col("next_id").isNull(), F.concat("triples", none)).otherwise(F.col("triples"))
    found = found.select("page_id", "revision_id", "nr", "next_id", "_late", F.size("triples").alias("_size"), F.posexplode(items).alias("pos", "t"))
    mark = F.when(F.col("_late"), "late").when(F.col("pos") == F.col("_size"), "last")
    found = found.select("page_id", "revision_id", "nr", "next_id", "pos", "t.*", mark.alias("mark"))
    if state is not None:
        first = rows.where(~old).groupBy("page_id").agg(F.min("revision_id").alias("next_id"))
        before = state.where("op = 'state'").join(first, "page_id")
        found = found.union(before.select("page_id", "revision_id", F.lit(0).cast("bigint"), "next_id", F.lit(0), "subject", "predicate", "object_", F.lit(None).cast("string")))
    found = with_changes(found, ("mark",))
    added, gone, stays = F.col("added") & (F.col("nr") > 0), F.col("gone"), F.col("next_id").isNull()
    op = F.when(F.col("mark") == "late", ops("late")).when(F.col("mark") == "last", ops("last"))
    op = op.when(added & gone, ops("add", "delete")).when(added & stays, ops("add", "state")).when(added, ops("add")).when(gone, ops("delete")).when(stays, ops("state"))
    out = found.withColumn("op", F.explode(op)).select("page_id", F.when(F.col("op") == "delete", F.col("next_id")).otherwise(F.col("revision_id")).alias("revision_id"), "op", "subject", "predicate", "object_")
    out.write.mode("overwrite").parquet(_folder(to, number, number + 1))
    merged = (number + 1) & -(number + 1)
    if merged > 1:
        runs = [r for r in _runs(number) if r[0] > number - merged]
        _states(spark, to, [*runs, (number, number + 1)]).write.mode("overwrite").parquet(_folder(to, number + 1 - merged, number + 1))


def _runs(number: int) -> list[tuple[int, int]]:
    """The first batches in runs, one for each binary digit that is set."""
    out, begin = [], 0
    for bit in reversed(range(number.bit_length())):
        if number >> bit & 1:
            out.append((begin, begin + (1 << bit)))
            begin += 1 << bit
    return out


def _folder(to: str, begin: int, end: int) -> str:
    return f"{to}/{begin}" if end == begin + 1 else f"{to}-state/{begin}-{end}"


def _states(spark: SparkSession, to: str, runs: list[tuple[int, int]]) -> DataFrame:
    """Of each page the last revision (op: last) and its state (op: state), as of the last of the runs that has the page."""
    every = reduce(DataFrame.union, [spark.read.schema(OUT).parquet(_folder(to, *r)).where(F.col("op").isin("state", "last")).withColumn("_run", F.lit(r[0])) for r in runs])
    newest = every.where("op = 'last'").groupBy("page_id").agg(F.max("_run").alias("_run"))
    return every.join(newest, ["page_id", "_run"]).select("page_id", "revision_id", "op", "subject", "predicate", "object_")
