"""The change-data-capture transform: histories of states as deletions and additions, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.triples import distinct_triples, object_key

KEY = ["subject", "predicate", "object_key"]


def delta(states: DataFrame) -> DataFrame:
    """Revisions with triples (array) to revisions with triple_deletions and triple_additions, by page in order of revision_id.

    Rows whose triples are null (they couldn't be converted) are left out and don't count as a state. A revision without
    a change stays, with empty arrays. Blank nodes are alike; an addition has the label of its own revision, a deletion
    that of the one before. For pages with large states, edges() needs less memory.
    """
    before = Window.partitionBy("page_id").orderBy("revision_id")
    none = F.map_from_entries(F.slice(F.map_entries("now"), 1, 0))
    rows = states.where(F.col("triples").isNotNull()).withColumn("now", distinct_triples(F.col("triples"))).withColumn("old", F.lag("now").over(before))
    rows = rows.withColumn("old", F.coalesce("old", none))

    def changed(here: str, there: str):
        gone = F.array_except(F.map_keys(here), F.map_keys(there))
        return F.array_sort(F.transform(gone, lambda k: F.struct(k["subject"].alias("subject"), k["predicate"].alias("predicate"), F.element_at(F.col(here), k).alias("object_"))))

    return rows.withColumns({"triple_deletions": changed("old", "now"), "triple_additions": changed("now", "old")}).drop("triples", "now", "old")


def flattened(states: DataFrame) -> DataFrame:
    """(page_id, revision_id, pos, subject, predicate, object_): one row for each triple of a state, with its place."""
    return states.where(F.col("triples").isNotNull()).select("page_id", "revision_id", F.posexplode("triples").alias("pos", "t")).select("page_id", "revision_id", "pos", "t.*")


def exploded(states: DataFrame) -> DataFrame:
    """(page_id, revision_id, subject, predicate, object_, object_key): one row for each distinct triple of a state."""
    return distinct_state(flattened(states))


def distinct_state(flat: DataFrame) -> DataFrame:
    """Triples (with pos, their place in the revision) without equal ones; of those the first."""
    return flat.groupBy("page_id", "revision_id", "subject", "predicate", object_key(F.col("object_")).alias("object_key")).agg(F.min_by("object_", "pos").alias("object_"))


def edges(revisions: DataFrame, state: DataFrame) -> DataFrame:
    """(page_id, revision_id, timestamp, op, subject, predicate, object_, object_key): what each revision adds and deletes.

    revisions: (page_id, revision_id, timestamp), the converted ones; state: see flattened() or exploded(); of equal triples
    of a revision the first counts. Revisions of a page are numbered; a triple is added where its last number isn't the
    one before, and deleted after its last number of a run.

    The numbers, one row for each revision, are joined to the triples, and these go once to partitions of (page, triple),
    where equal ones of a revision meet and runs are found; no page's whole state is ever held.
    """
    return numbered_edges(state.join(numbered(revisions), ["page_id", "revision_id"]))


def numbered(revisions: DataFrame) -> DataFrame:
    """(page_id, revision_id, timestamp, nr, next_id, next_time): revisions with their number and the one after them on their page."""
    page = Window.partitionBy("page_id").orderBy("revision_id")
    return revisions.select("page_id", "revision_id", "timestamp", F.row_number().over(page).alias("nr"), F.lead("revision_id").over(page).alias("next_id"), F.lead("timestamp").over(page).alias("next_time"))


def numbered_edges(rows: DataFrame) -> DataFrame:
    """As edges(), of triples that have the columns of numbered() already."""
    out = with_changes(rows).withColumn("op", F.explode(F.when(F.col("added") & F.col("gone"), ops("add", "delete")).when(F.col("added"), ops("add")).when(F.col("gone"), ops("delete"))))
    gone = F.col("op") == "delete"
    at, time = [F.when(gone, F.col(b)).otherwise(F.col(a)) for a, b in (("revision_id", "next_id"), ("timestamp", "next_time"))]
    return out.select("page_id", at.alias("revision_id"), time.alias("timestamp"), "op", "subject", "predicate", "object_", "object_key")


def ops(*names: str) -> Column:
    return F.array(*[F.lit(x) for x in names])


def with_changes(rows: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """Numbered triples, of equal ones of a revision the first, with object_key, added and gone (after this revision).

    Rows that have something in a column of marks are no triples and stay. One shuffle and one sort serve all; both go by a
    hash of page and triple first, so that few comparisons look at the strings.
    """
    key = object_key(F.col("object_"))
    found = rows.withColumn("_hash", F.xxhash64("page_id", "subject", "predicate", key, *marks)).repartition("_hash").withColumn("object_key", key)
    same = Window.partitionBy("_hash", "page_id", *KEY, *marks).orderBy("nr", *(["pos"] if "pos" in rows.columns else []))
    first = ~F.lag("nr").over(same).eqNullSafe(F.col("nr"))
    for m in marks:
        first = first | F.col(m).isNotNull()
    found = found.withColumn("_first", first).where("_first").withColumns({"_last": F.lag("nr").over(same), "_next": F.lead("nr").over(same)})
    added = F.col("_last").isNull() | (F.col("_last") < F.col("nr") - 1)
    gone = F.col("next_id").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("nr") + 1))
    return found.withColumns({"added": added, "gone": gone}).drop("_hash", "_first", "_last", "_next")


def gathered(revisions: DataFrame, log: DataFrame) -> DataFrame:
    """The edge log as arrays on its revisions; a revision without a change has empty ones."""
    triple = F.struct("subject", "predicate", "object_")
    sides = [F.sort_array(F.collect_list(F.when(F.col("op") == op, triple))).alias(name) for op, name in (("delete", "triple_deletions"), ("add", "triple_additions"))]
    arrays = log.groupBy("page_id", "revision_id").agg(*sides)
    empty = F.from_json(F.lit("[]"), "array<struct<subject:string,predicate:string,object_:string>>")
    return revisions.join(arrays, ["page_id", "revision_id"], "left").withColumns({c: F.coalesce(c, empty) for c in ("triple_deletions", "triple_additions")})


def counted(revisions: DataFrame, log: DataFrame) -> DataFrame:
    """(page_id, revision_id, additions, deletions): how many triples each revision adds and deletes; no triples are gathered for that."""
    n = log.groupBy("page_id", "revision_id").agg(F.count_if(F.col("op") == "add").alias("additions"), F.count_if(F.col("op") == "delete").alias("deletions"))
    zero = F.lit(0).cast("bigint")
    return revisions.select("page_id", "revision_id").join(n, ["page_id", "revision_id"], "left").select("page_id", "revision_id", *[F.coalesce(c, zero).alias(c) for c in ("additions", "deletions")])


def log_of(deltas: DataFrame) -> DataFrame:
    """The edge log of revisions with arrays."""

    def side(c: str, op: str):  # a lambda's second parameter would be the index
        return F.transform(c, lambda t: F.struct(F.lit(op).alias("op"), t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["object_"].alias("object_")))

    sides = F.concat(side("triple_deletions", "delete"), side("triple_additions", "add"))
    return deltas.select("page_id", "revision_id", "timestamp", F.inline(sides)).withColumn("object_key", object_key(F.col("object_")))


def replay(log: DataFrame, revision_id: int | None = None) -> DataFrame:
    """(page_id, subject, predicate, object_): the state of each page after the revision (null: the last one)."""
    past = log if revision_id is None else log.where(F.col("revision_id") <= revision_id)
    # of one revision's events the addition is the later one
    last = F.max_by(F.struct("op", "object_"), F.struct("revision_id", (F.col("op") == "add").alias("add")))
    return past.groupBy("page_id", *KEY).agg(last.alias("e")).where("e.op = 'add'").select("page_id", "subject", "predicate", F.col("e.object_").alias("object_"))
