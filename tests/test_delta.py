from datetime import datetime

import pandas as pd
import pytest

from revlens.operators import delta, filters, ranges, validate
from revlens.streaming import deltas as streaming

SCHEMA = "page_id bigint, revision_id bigint, timestamp timestamp, triples array<struct<subject string, predicate string, object_ string>>"
A, B, C = ("s", "p", "a"), ("s", "p", "b"), ("s", "p", "c")
N1, N2 = ("s", "q", "_:n1"), ("s", "q", "_:n2")


def states():
    at = datetime(2020, 1, 1)
    triples = [[A, B], None, [B, A, A], [B, C, N1], [B, C, N2], [B, N2][:1], []]
    return [(1, i + 1, at, t) for i, t in enumerate(triples)]


WANT = {1: ([], [A, B]), 3: ([], []), 4: ([A], [C, N1]), 5: ([], []), 6: ([C, N2], []), 7: ([B], [])}


def test_truth_table(spark):
    got = {r["revision_id"]: ([tuple(t) for t in r["triple_deletions"]], [tuple(t) for t in r["triple_additions"]]) for r in delta.delta(spark.createDataFrame(states(), SCHEMA)).collect()}
    assert got == WANT


def test_edges_equal_arrays(spark):
    df = spark.createDataFrame(states(), SCHEMA)
    rows = df.where("triples IS NOT NULL").select("page_id", "revision_id", "timestamp")
    got = delta.gathered(rows, delta.edges(rows, delta.exploded(df)))
    assert {r["revision_id"]: ([tuple(t) for t in r["triple_deletions"]], [tuple(t) for t in r["triple_additions"]]) for r in got.collect()} == WANT


def test_replay(spark):
    log = delta.log_of(delta.delta(spark.createDataFrame(states(), SCHEMA)))
    for until, want in ((3, {A, B}), (4, {B, C, N1}), (7, set())):
        assert {(r["subject"], r["predicate"], r["object_"]) for r in delta.replay(log, until).collect()} == want
    assert validate.both_added_and_deleted(log).isEmpty() and validate.deleted_before_added(log).isEmpty()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert delta.delta(empty).isEmpty() and delta.replay(delta.log_of(delta.delta(empty))).isEmpty()


def test_one_page_or_a_range(spark):
    df = spark.createDataFrame(states(), SCHEMA)
    with pytest.raises(ValueError):
        filters.select_revisions(df, page_id=1, min_page_id=1)
    assert filters.select_revisions(df, page_id=9).isEmpty()
    assert filters.select_revisions(df, min_revision_id=0, max_revision_id=2).count() == 2


def test_large_states_take_their_time_in_proportion(spark):
    """A page of 30 revisions with 2,000 triples each, of which one goes and one comes."""
    rows = [(1, r, datetime(2020, 1, 1), [("s", "p", str(x)) for x in range(r, r + 2000)]) for r in range(1, 31)]
    df = spark.createDataFrame(rows, SCHEMA)
    log = delta.edges(df.select("page_id", "revision_id", "timestamp"), delta.flattened(df))
    assert {(r["op"], r["count"]) for r in log.groupBy("op").count().collect()} == {("add", 2029), ("delete", 29)}


def test_bounds_with_a_zone_are_taken_in_utc():
    from datetime import timedelta, timezone

    assert filters.utc(datetime(2020, 2, 1, 5, tzinfo=timezone(timedelta(hours=14)))) == datetime(2020, 1, 31, 15, tzinfo=timezone.utc)
    assert filters.utc(datetime(2020, 2, 1, 5, tzinfo=timezone(timedelta(hours=14)))).date().month == 1


def test_range_map(spark):
    m = spark.createDataFrame([(0, 10, "a"), (10, 20, "b"), (30, 40, "c")], "start bigint, stop bigint, value string")
    points = spark.createDataFrame([(x,) for x in (0, 9, 10, 25, 39, 40)], "k bigint")
    want = {0: "a", 9: "a", 10: "b", 39: "c"}
    assert {r["k"]: r["value"] for r in ranges.point_lookup(points, "k", m).collect()} == want
    assert {r["k"]: r["value"] for r in ranges.point_lookup(points, "k", m, rows=10**9).collect()} == want
    wide = m.union(spark.createDataFrame([(40, 10**10, "d")], m.schema))
    far = spark.createDataFrame([(39,), (40,), (10**9,), (10**10,), (None,), (-5,)], "k bigint")
    for rows in (None, 10**9):
        assert {r["k"]: r["value"] for r in ranges.point_lookup(far, "k", wide, rows=rows).collect()} == {39: "c", 40: "d", 10**9: "d"}
        assert ranges.point_lookup(far, "k", m.limit(0), rows=rows).count() == 0
    assert sorted(r["k"] for r in ranges.has_key(points, "k", m).collect()) == sorted(want)
    with pytest.raises(ValueError):
        ranges.with_range(m, 19, 25, "d")
    assert ranges.with_range(m, 20, 25, "d").count() == 4 and ranges.without_range(m, 0, 10).count() == 2


class _State:
    exists = False

    def update(self, x):
        self.get, self.exists = x, True


def test_stream_steps_equal_batch():
    """The state function over two batches gives the batch transform's log."""
    frame = pd.DataFrame([(r, None if t is None else [dict(zip(("subject", "predicate", "object_"), x)) for x in t]) for _, r, _, t in states()], columns=["revision_id", "triples"])
    state, got = _State(), []
    for part in (frame[:3], frame[3:]):
        for out in streaming._step((1,), iter([part]), state):
            got += [(r.revision_id, r.op, (r.subject, r.predicate, r.object_)) for r in out.itertuples()]
    want = [(r, op, t) for r, (gone, new) in WANT.items() for op, ts in (("delete", gone), ("add", new)) for t in ts]
    assert sorted(got) == sorted(want)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame(states(), SCHEMA)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    query = streaming.stream_edges(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["revision_id"], r["op"], r["object_"]) for r in spark.table("edges").collect())
    assert got == sorted((r, op, t[2]) for r, (gone, new) in WANT.items() for op, ts in (("delete", gone), ("add", new)) for t in ts)


def test_stream_started(spark, tmp_path):
    """Batches of one file each, with late, repeated, empty and unconverted rows and a page that isn't in each, give what the state function gives."""
    empty, page2 = [(3, 1, None, [])], [(2, 5, None, [A, B]), (2, 4, None, [A])]
    batches = [states()[:2] + page2[:1], states()[2:4] + empty, states()[4:5] + page2[1:] + [(2, 5, None, None), (2, 6, None, [B, N1])], states()[5:], [(3, 2, None, [N2]), (1, 9, None, [A]), (1, 9, None, [A])], [(2, 7, None, [N2, C])]]
    kept, want = {}, []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        for page in {r[0] for r in batch}:
            rows = [(r[1], None if r[3] is None else [dict(zip(("subject", "predicate", "object_"), x)) for x in r[3]]) for r in batch if r[0] == page]
            for out in streaming._step((page,), iter([pd.DataFrame(rows, columns=["revision_id", "triples"])]), kept.setdefault(page, _State())):
                want += [tuple(r) for r in out.astype(object).where(out.notna(), None).itertuples(index=False)]
    to = str(tmp_path / "out")
    for i in range(len(batches)):
        streaming._batch(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / str(i))), i, to)
    assert {"late", "add", "delete"} == {r[2] for r in want}
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in streaming.log(spark, to).collect())


def test_stream_started_has_no_python_workers(spark, tmp_path):
    """Python's state function took most of the time of large streams."""
    df = spark.createDataFrame(states(), SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    to = str(tmp_path / "out")
    query = streaming.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), to)
    query.awaitTermination(120)
    assert len(list((tmp_path / "out").glob("[0-9]*"))) > 1
    assert not any(p["stateOperators"] for p in query.recentProgress) and {r["op"] for r in streaming.log(spark, to).collect()} <= {"add", "delete", "late"}


def test_sizes_are_counted_without_arrays(spark):
    from revlens.plans import queries

    for name in ("delta_size_hist", "delta_size_bins"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "min_by" not in plan


def test_equal_triples_take_no_aggregate(spark):
    """The first of equal triples was found by an aggregate of strings, which sorts by all columns; and numbers were joined to each triple."""
    from revlens.plans import queries

    plan = queries.QUERIES["delta_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "array_sort" not in plan and plan.count("Join") == 2
