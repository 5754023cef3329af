"""Guarded upsert: laws and edge cases."""

from datetime import datetime, timedelta
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.compare import plan
from tidewater.operators import merge
from tidewater.operators.conform import latest_by_key

DDL = "k int, seq int, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


@pytest.mark.parametrize("small", [False, True])
def test_newer_wins_equal_and_older_do_nothing(spark, small):
    held = frame(spark, [(1, 5, "a"), (2, 5, "b"), (3, 5, "c"), (4, 5, "d")])
    sent = frame(spark, [(1, 6, "newer"), (2, 5, "equal"), (3, 4, "older"), (5, 1, "new")])
    assert rows(merge.upsert(held, sent, ["k"], "seq", small_batch=small)) == rows(frame(
        spark, [(1, 6, "newer"), (2, 5, "b"), (3, 5, "c"), (4, 5, "d"), (5, 1, "new")]))


@pytest.mark.parametrize("small", [False, True])
def test_null_sequence_can_be_corrected_but_does_not_correct(spark, small):
    held = frame(spark, [(1, None, "a"), (2, 5, "b"), (3, None, "c")])
    sent = frame(spark, [(1, 1, "fixed"), (2, None, "no"), (3, None, "still without")])
    assert rows(merge.upsert(held, sent, ["k"], "seq", small_batch=small)) == rows(frame(
        spark, [(1, 1, "fixed"), (2, 5, "b"), (3, None, "still without")]))


@pytest.mark.parametrize("small", [False, True])
def test_null_key_is_inserted_again_unless_null_safe(spark, small):
    held, sent = frame(spark, [(None, 1, "a")]), frame(spark, [(None, 2, "b")])
    merged = lambda null_safe: rows(merge.upsert(
        held, sent, ["k"], "seq", null_safe=null_safe, small_batch=small))
    assert merged(False) == [(None, 1, "a"), (None, 2, "b")]
    assert merged(True) == [(None, 2, "b")]
    assert merge.null_key_rows(held, ["k"]).count() == 1


def test_silver_does_not_evolve(spark):
    held = frame(spark, [(1, 1, "a")])
    wider = spark.createDataFrame([(1, 2, "b", 9)], "K int, seq int, v string, extra int")
    merged = merge.upsert(held, wider, ["k"], "seq")
    assert merged.columns == ["k", "seq", "v"] and rows(merged) == [(1, 2, "b")]
    with pytest.raises(ValueError, match="silver column"):
        merge.upsert(held, spark.createDataFrame([(1, 2)], "k int, seq int"), ["k"], "seq")


deliveries = st.lists(
    st.lists(st.tuples(st.integers(1, 4), st.integers(0, 30), st.sampled_from("xyz")), max_size=6),
    min_size=1, max_size=3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(deliveries)
def test_deliveries_commute_and_are_idempotent(spark, batches):
    unique = {}
    for n, batch in enumerate(batches):
        for k, seq, v in batch:
            unique.setdefault((k, seq), (n, v))
    batches = [[(k, seq, v) for (k, seq), (m, v) in unique.items() if m == n]
               for n in range(len(batches))]
    apply = lambda order: reduce(
        lambda state, b: merge.upsert(state, frame(spark, b), ["k"], "seq"), order, frame(spark, []))
    expected = {}
    for k, seq, v in (r for b in batches for r in b):
        if k not in expected or seq > expected[k][0]:
            expected[k] = (seq, v)
    wanted = sorted(((k, seq, v) for k, (seq, v) in expected.items()), key=repr)
    assert rows(apply(batches)) == wanted
    assert rows(apply(batches[::-1] + batches)) == wanted


def test_late_upsert_does_not_resurrect(spark):
    ddl = "k int, seq int, v string, gone boolean"
    empty = spark.createDataFrame([], ddl)
    step = lambda state, data: merge.upsert_with_deletes(
        state, spark.createDataFrame(data, ddl), ["k"], "seq", "gone", null_flag_deletes=False)
    state = step(empty, [(1, 1, "a", False), (2, 1, "b", None)])
    state = step(state, [(1, 5, None, True)])
    state = step(state, [(1, 3, "late", False)])
    assert rows(merge.live_rows(state, "gone")) == [(2, 1, "b")]
    state = step(state, [(1, 6, "back", False)])
    assert rows(merge.live_rows(state, "gone")) == [(1, 6, "back"), (2, 1, "b")]
    unknown = step(empty, [(7, 9, "x", True)])
    assert rows(merge.live_rows(step(unknown, [(7, 8, "old", False)]), "gone")) == []


def test_missing_flag_means_what_the_caller_says(spark):
    ddl = "k int, seq int, gone boolean"
    held, sent = spark.createDataFrame([(1, 1, False)], ddl), spark.createDataFrame([(1, 2, None)], ddl)
    for deletes, left in ((True, 0), (False, 1)):
        state = merge.upsert_with_deletes(held, sent, ["k"], "seq", "gone", null_flag_deletes=deletes)
        assert merge.live_rows(state, "gone").count() == left


def test_merge_on_read_needs_a_newer_delete(spark):
    data = frame(spark, [(1, 1, "a"), (1, 9, "b"), (2, 3, "c")])
    deletes = spark.createDataFrame([(1, 5), (1, 2), (2, 3)], "k int, seq int")
    assert rows(merge.merge_on_read(data, deletes, ["k"], "seq")) == [(1, 9, "b"), (2, 3, "c")]


def test_positional_deletes(spark):
    data = spark.createDataFrame([("f1", 0, "a"), ("f1", 1, "b"), ("f2", 0, "c")], "file string, pos int, v string")
    gone = spark.createDataFrame([("f1", 1), ("f1", 1)], "file string, pos int")
    assert rows(merge.drop_positions(data, gone, "file", "pos")) == [("f1", 0, "a"), ("f2", 0, "c")]


def test_ties_use_columns_in_declared_order_and_nulls_last_in_sequence(spark):
    data = frame(spark, [(1, 5, "b"), (1, 5, "a"), (1, None, "z"), (2, None, "q")])
    assert rows(latest_by_key(data, ["k"], "seq")) == [(1, 5, "a"), (2, None, "q")]


def test_audit_columns_do_not_break_ties(spark):
    ddl = "k int, seq int, v string, _ingested_at int"
    first = spark.createDataFrame([(1, 1, "a", 9), (1, 1, "b", 1)], ddl)
    again = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 9)], ddl)
    pick = lambda df: latest_by_key(df, ["k"], "seq").first()["v"]
    assert pick(first) == pick(again) == "a"


def test_staging_lag(spark):
    lag = merge.staging_lag(frame(spark, [(1, 3, "a")]), frame(spark, [(1, 2, "a"), (2, 5, "b")]), "seq")
    assert tuple(lag.first()) == (5, 3, 1)
    empty = merge.staging_lag(frame(spark, []), frame(spark, [(1, 2, "a"), (2, 5, "b")]), "seq")
    assert tuple(empty.first()) == (5, None, 2)


def test_bitmaps_drop_named_positions_without_moving_data(spark, tmp_path):
    data = spark.createDataFrame([(f, p) for f in ("a", "b", None) for p in (0, 1, 7, 8, 32766, 32767, 32768, 99_999, None)],
                                 "file string, pos long")
    named = [("a", 0), ("a", 32767), ("a", 32768), ("a", 99_999), ("b", 8), ("b", 8), ("c", 1), (None, 1), ("b", None), ("b", -1)]
    early, late = (merge.deletion_bitmaps(spark.createDataFrame(named[n::2], "file string, pos long"), "file", "pos") for n in (0, 1))
    merged = merge.merged_bitmaps(early, late, "file")
    assert merged.select("file", "_bucket").distinct().count() == merged.count() == 5
    merged.write.parquet(str(tmp_path / "bitmaps"))
    data.write.parquet(str(tmp_path / "data"))
    stored = spark.read.parquet(str(tmp_path / "data"))
    left = merge.drop_bitmap_positions(stored, spark.read.parquet(str(tmp_path / "bitmaps")), "file", "pos")
    gone = {n for n in named if None not in n}
    assert rows(left) == sorted([tuple(r) for r in data.collect() if tuple(r) not in gone], key=repr)
    text = plan(left)
    tree = text.split("\n\n")[0]
    assert "BroadcastHashJoin" in tree and "Exchange" not in tree.replace("BroadcastExchange", "")


def test_staged_deliveries_are_merged_once_up_to_the_fence(spark, tmp_path):
    ddl = "k int, seq int, v string, at timestamp"
    moment = datetime(2026, 1, 1)
    staging = merge.Staging(str(tmp_path / "staging"), ["k"], "seq")
    empty = frame(spark, [], ddl)
    due = lambda now, count=10: staging.due(spark, empty.schema, now, count, timedelta(hours=1), "at")
    assert not due(moment) and not staging.merge(spark, empty, 5, lambda _: None)
    staging.stage(frame(spark, [(1, 1, "a", moment), (2, 1, "b", moment)], ddl), 0)
    staging.stage(frame(spark, [(1, 2, "newer", moment)], ddl), 1)
    assert not due(moment) and due(moment, 3) and due(moment + timedelta(hours=1))
    stored = []

    def keep(df):
        path = str(tmp_path / f"state{len(stored)}")
        df.write.parquet(path)
        stored.append(spark.read.schema(ddl).parquet(path))

    def broken(df):
        raise OSError("store is away")

    with pytest.raises(OSError):
        staging.merge(spark, empty, 1, broken)
    assert staging.fence(spark) == -1
    assert staging.merge(spark, empty, 1, keep) and staging.fence(spark) == 1
    assert [(r["k"], r["v"]) for r in stored[0].orderBy("k").collect()] == [(1, "newer"), (2, "b")]
    assert not staging.merge(spark, stored[0], 1, keep) and len(stored) == 1  # the same turn once more
    staging.stage(frame(spark, [(1, 1, "late", moment), (3, 1, "c", moment)], ddl), 2)
    staging.stage(frame(spark, [(1, 1, "late", moment), (3, 1, "c", moment)], ddl), 2)
    assert staging.waiting(spark, empty.schema).count() == 2
    assert staging.merge(spark, stored[0], 2, keep)
    assert [(r["k"], r["v"]) for r in stored[1].orderBy("k").collect()] == [(1, "newer"), (2, "b"), (3, "c")]
