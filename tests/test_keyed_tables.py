"""Versioned keyed tables: empty ones, atomic commits, replays, conflicts, compaction."""

import pytest

from cinelytics.session import scratch_path
from cinelytics.sources import tables as tb

SCHEMA = "userid int, movieid int, degree float"


def rows_of(spark, path, version=None):
    return sorted((tuple(r) for r in tb.read_keyed_table(spark, path, version).collect()), key=str)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_empty_table_can_be_read_appended_and_replaced(spark):
    for first in ("read", "append", "replace", "keys", "remove"):
        path = scratch_path(spark, "empty")
        tb.create_keyed_table(frame(spark), path, "userid")
        assert tb.read_keyed_table(spark, path).schema.simpleString() == "struct<userid:int,movieid:int,degree:float>"
        one = frame(spark, (1, 2, 3.0))
        if first == "read":
            assert rows_of(spark, path) == []
        elif first == "append":
            tb.append_rows(one, path, "userid")
            assert rows_of(spark, path) == [(1, 2, 3.0)]
        elif first == "replace":
            tb.replace_by_key(spark, path, one, "userid")
            assert rows_of(spark, path) == [(1, 2, 3.0)]
        elif first == "keys":
            assert tb.read_rows_for_keys(spark, path, one, "userid").count() == 0
        else:
            tb.replace_by_key(spark, path, frame(spark), "userid", replaced=one)
            assert rows_of(spark, path) == []


def test_the_last_rows_can_go_and_come_back(spark):
    path = scratch_path(spark, "last")
    tb.create_keyed_table(frame(spark, (1, 2, 3.0), (2, 2, 1.0)), path, "userid")
    tb.replace_by_key(spark, path, frame(spark), "userid", replaced=frame(spark, (1, 0, 0.0), (2, 0, 0.0)))
    assert rows_of(spark, path) == []
    tb.append_rows(frame(spark, (3, 3, 3.0)), path, "userid")
    assert rows_of(spark, path) == [(3, 3, 3.0)]


@pytest.mark.parametrize("operation", ["append", "replace", "create"])
def test_a_failure_before_the_commit_leaves_the_old_rows(spark, monkeypatch, operation):
    path = scratch_path(spark, "failure")
    old, new = frame(spark, (1, 1, 1.0), (2, 2, 2.0)), frame(spark, (1, 9, 9.0))
    tb.create_keyed_table(old, path, "userid", buckets=2)
    before = tb.read_keyed_table(spark, path)

    def run():
        if operation == "append":
            tb.append_rows(new, path, "userid")
        elif operation == "replace":
            tb.replace_by_key(spark, path, new, "userid")
        else:
            tb.create_keyed_table(new, path, "userid", buckets=3)

    with monkeypatch.context() as m:
        m.setattr(tb, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            run()
    assert rows_of(spark, path) == [(1, 1, 1.0), (2, 2, 2.0)]
    run()
    want = {"append": [(1, 1, 1.0), (1, 9, 9.0), (2, 2, 2.0)], "replace": [(1, 9, 9.0), (2, 2, 2.0)], "create": [(1, 9, 9.0)]}
    assert rows_of(spark, path) == want[operation]
    assert sorted(map(tuple, before.collect())) == [(1, 1, 1.0), (2, 2, 2.0)]  # an open reader keeps its version
    tb.vacuum(spark, path, keep=1)
    assert rows_of(spark, path) == want[operation]


def test_a_replayed_batch_is_a_no_op(spark):
    path = scratch_path(spark, "replay")
    tb.create_keyed_table(frame(spark), path, "userid")
    for number, rows in ((0, [(1, 1, 1.0)]), (1, [(1, 2, 2.0)]), (0, [(1, 1, 1.0)]), (1, [(1, 2, 2.0)])):
        tb.append_rows(frame(spark, *rows), path, "userid", batch=("s", number))
    assert rows_of(spark, path) == [(1, 1, 1.0), (1, 2, 2.0)]
    tb.replace_by_key(spark, path, frame(spark, (1, 5, 5.0)), "userid", batch=("s", 1))
    assert len(rows_of(spark, path)) == 2
    tb.replace_by_key(spark, path, frame(spark, (1, 5, 5.0)), "userid", batch=("other", 1))
    assert rows_of(spark, path) == [(1, 5, 5.0)]


def test_a_second_writer_of_a_version_is_refused(spark):
    path = scratch_path(spark, "conflict")
    tb.create_keyed_table(frame(spark, (1, 1, 1.0)), path, "userid")
    stale = tb.read_commit(spark, path)
    tb.append_rows(frame(spark, (2, 2, 2.0)), path, "userid")
    with pytest.raises(tb.CommitConflict):
        tb._commit(spark, path, {**stale, "version": stale["version"] + 1})
    assert rows_of(spark, path) == [(1, 1, 1.0), (2, 2, 2.0)]


def test_null_keys_and_two_column_keys(spark):
    path = scratch_path(spark, "nulls")
    tb.create_keyed_table(frame(spark, (None, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0)), path, ["userid", "movieid"], buckets=3)
    for _ in range(2):
        tb.replace_by_key(spark, path, frame(spark, (None, 1, 7.0), (1, 2, 8.0)), ["userid", "movieid"])
        assert rows_of(spark, path) == [(1, 1, 1.0), (1, 2, 8.0), (None, 1, 7.0)]
    got = tb.read_rows_for_keys(spark, path, frame(spark, (None, 1, 0.0)), ["userid", "movieid"]).collect()
    assert [tuple(r) for r in got] == [(None, 1, 7.0)]


def test_appends_are_merged_and_vacuumed(spark):
    path = scratch_path(spark, "appends")
    tb.create_keyed_table(frame(spark), path, "userid", buckets=1)
    for i in range(tb.MAX_FOLDERS + 3):
        tb.append_rows(frame(spark, (i, i, 0.0)), path, "userid")
        tb.vacuum(spark, path)
        assert len(rows_of(spark, path)) == i + 1
    assert len(tb.read_commit(spark, path)["folders"]["0"]) < tb.MAX_FOLDERS
    assert len(tb.table_versions(spark, path)) == 2
    first, last = tb.table_versions(spark, path)
    assert len(rows_of(spark, path, first)) == len(rows_of(spark, path, last)) - 1


def test_missing_table_says_so(spark):
    with pytest.raises(FileNotFoundError):
        tb.read_keyed_table(spark, scratch_path(spark, "none"))
