"""Streams over several files (one file per micro-batch) equal their batch twins."""

from pyspark.sql import functions as F

from cinelytics import fixtures as fx
from cinelytics.operators import ratings as rt
from cinelytics.operators import status as st
from cinelytics.queries_stream import event_stream
from cinelytics.session import scratch_path
from cinelytics.sources import tables as tb
from cinelytics.streaming import incremental as inc
from cinelytics.streaming import state

from .conftest import SF_SMALL


def _events(spark):
    """The event table as a stream of four files, one per micro-batch."""
    path = scratch_path(spark, "events-split")
    fx.table(spark, SF_SMALL, "events").repartition(4, "event_id").write.parquet(path)
    return event_stream(spark, path, files_per_trigger=1, glob="*.parquet")


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_keyed_updates_run_one_batch_per_file(spark):
    agg = fx.progress_rows(_events(spark)).groupBy("userid").agg(F.count(F.lit(1)).alias("n"))
    out = state.run_keyed_updates(agg, "batches", ["userid"])
    commit = tb.read_commit(spark, out)
    assert commit["batches"] == {"batches": 3} and commit["version"] == 5  # the empty table, then four files
    want = fx.progress_v(spark, SF_SMALL).groupBy("userid").agg(F.count(F.lit(1)).alias("n"))
    assert _rows(tb.read_keyed_table(spark, out), "userid", "n") == _rows(want, "userid", "n")


def test_state_is_bounded_by_keys_not_batches(spark):
    """50 batches over the same 20 keys: two versions of files stay, and the last row of each key."""
    import os

    path, view = scratch_path(spark, "bounded-state"), inc.recommendations_count_view(scratch_path(spark, "bounded-view"))
    sizes = []
    schema = "userid int, n int"
    tb.create_keyed_table(spark.createDataFrame([], schema), path, "userid", buckets=2)
    for i in range(50):
        rows = spark.createDataFrame([(u, i) for u in range(i % 7, 20)], schema).coalesce(1)
        state.merge_batch(rows, path, ["userid"], "s", i, [view] if i in (10, 11) else [])
        if i in (11, 30):
            state.merge_batch(rows, path, ["userid"], "s", i)  # replayed
        sizes.append(sum(f.endswith(".parquet") for _, _, fs in os.walk(path.removeprefix("file:")) for f in fs))
    assert max(sizes[5:]) <= 16  # two versions, two buckets, kept and new rows, a few files each
    last = {u: max(i for i in range(50) if i % 7 <= u) for u in range(20)}
    assert _rows(tb.read_keyed_table(spark, path), "userid", "n") == sorted(last.items())


def test_signed_views_equal_the_batch_query(spark):
    """Replaces, deletions, replays and a crash between the table's commit and the view's."""
    path, view = scratch_path(spark, "signed"), inc.rating_stats_view(scratch_path(spark, "signed-view"))
    schema = "userid int, movieid int, rating int"
    own = spark.createDataFrame([(u, m, (u * m) % 5 + 1) for u in range(6) for m in range(u + 1)] + [(7, 1, None)], schema)
    tb.create_keyed_table(own, path, "userid", buckets=3)
    view.create(own, buckets=2)

    def check():
        want = rt.rating_stats(tb.read_keyed_table(spark, path))
        cols = ["userid", "total_ratings", *[f"n_{k}" for k in range(1, 6)]]
        assert _rows(inc.rating_stats(view, spark), *cols) == _rows(want, *cols)
        means = {r.userid: r.avg_rating for r in want.collect()}
        assert {r.userid: r.avg_rating for r in inc.rating_stats(view, spark).collect()} == means

    check()
    batches = [([(1, 9, 5), (8, 1, 2)], None), ([], [2, 3, 99]), ([(1, 9, 4), (2, 2, 2)], [8]), ([(0, 0, None)], None)]
    for number, (rows, gone) in enumerate(batches):
        new = spark.createDataFrame(rows, schema)
        replaced = spark.createDataFrame([(u,) for u in gone], "userid int") if gone else None
        args = (spark, path, new, "userid", [view], replaced, ("s", number))
        if number == 2:  # the table takes the batch, the view doesn't
            real = inc.SignedView.apply
            inc.SignedView.apply = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
            try:
                inc.replace_with_views(*args)
                raise AssertionError("the failure was swallowed")
            except RuntimeError:
                pass
            finally:
                inc.SignedView.apply = real
        inc.replace_with_views(*args)
        check()
        inc.replace_with_views(*args)  # replayed
        check()
    assert {r.userid for r in view.read(spark).collect()} == {0, 1, 2, 4, 5, 7}


def test_progress_stream_over_several_batches_equals_batch(spark):
    got = state.stream_progress_latest(fx.progress_rows(_events(spark)))
    want = st.progress_latest(fx.progress_v(spark, SF_SMALL))
    cols = ["userid", "event_id", "progress", "step"]
    assert _rows(got, *cols) == _rows(want, *cols)


def test_favorites_stream_over_several_batches_equals_batch(spark):
    got = state.stream_favorites_dedup(fx.favorite_rows(_events(spark)))
    cols = ["id", "userid", "movieid", "category", "createtime"]
    assert _rows(got, *cols) == _rows(fx.favorites_v(spark, SF_SMALL), *cols)


def test_bounded_favorites_stream_keeps_every_key_within_the_delay(spark):
    got = state.stream_favorites_dedup_bounded(fx.favorite_rows(_events(spark)), "365 days")
    cols = ["userid", "movieid", "category"]
    assert _rows(got, *cols) == _rows(fx.favorites_v(spark, SF_SMALL), *cols)


def test_replace_stream_over_several_batches_equals_batch(spark):
    cols = ["userid", "movieid", "rating", "timestamp"]
    personal = fx.my_ratings_v(spark, SF_SMALL)
    path = scratch_path(spark, "ratings-stream-test")
    tb.create_keyed_table(personal, path, "userid", buckets=3)
    state.stream_replace_ratings(fx.submission_rows(_events(spark)), path)
    latest = rt.latest_submission(rt.well_formed(fx.submissions_v(spark, SF_SMALL)))
    want = rt.replace_user_ratings(personal, latest, rt.valid_submissions(latest.drop("n_submissions")))
    assert _rows(tb.read_keyed_table(spark, path), *cols) == _rows(want, *cols)


def test_replace_removes_a_key_that_gets_no_row(spark):
    path = scratch_path(spark, "ratings-empty-bucket")
    old = spark.createDataFrame([(u, 1) for u in range(6)], "userid int, movieid int")
    tb.create_keyed_table(old, path, "userid", buckets=64)  # most users alone in their bucket
    tb.replace_by_key(spark, path, old.limit(0), "userid", replaced=old.where("userid in (2, 3)"))
    assert [u for u, _ in _rows(tb.read_keyed_table(spark, path), "userid", "movieid")] == [0, 1, 4, 5]
