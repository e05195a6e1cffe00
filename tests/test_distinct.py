"""Mergeable distinct counts against countDistinct."""

import random


from cinelytics.operators import distinct as dc
from cinelytics.operators import split as sp
from cinelytics.session import scratch_path

SCHEMA = "userid long, movieid int, rating double, ts long"


def rows(seed, days, n):
    rng = random.Random(seed)
    ids = [0, 1, -1, 32_767, 32_768, 32_769, -32_768, -32_769, 2**40, None, *range(50)]
    return [(rng.choice(ids), rng.choice([None, 1, 2, 2**31 - 1, -2**31, rng.randint(0, 10**6)]), 1.0,
             rng.choice(days) * dc.SECONDS + rng.randint(0, 86_399)) for _ in range(n)]


def check(spark, path, ratings, **days):
    want = ratings
    if days:
        want = ratings.where(dc.day_of().between(days["first"], days["last"]))
    assert dc.dataset_stats(spark, path, **days).collect() == sp.dataset_stats(want).collect()
    assert dc.split_counts(spark, path, **days).collect() == sp.split_counts(sp.time_mod_split(want)).collect()


def test_days_merge_to_the_whole(spark):
    old, new = rows(1, [-2, 0, 5, 6], 400), rows(2, [7], 60)
    path = scratch_path(spark, "days")
    dc.create(spark.createDataFrame(old, SCHEMA), path, buckets=3)
    check(spark, path, spark.createDataFrame(old, SCHEMA))
    for _ in range(2):  # a day put twice counts once
        dc.put_days(spark, path, spark.createDataFrame(new, SCHEMA))
        both = spark.createDataFrame(old + new, SCHEMA)
        check(spark, path, both)
    check(spark, path, both, first=5, last=7)
    again = rows(3, [0], 30)  # a corrected day
    dc.put_days(spark, path, spark.createDataFrame(again, SCHEMA))
    kept = both.where(dc.day_of() != 0).unionByName(spark.createDataFrame(again, SCHEMA))
    check(spark, path, kept)


def test_empty_and_null(spark):
    path = scratch_path(spark, "days-empty")
    dc.create(spark.createDataFrame([], SCHEMA), path)
    check(spark, path, spark.createDataFrame([], SCHEMA))
    odd = spark.createDataFrame([(None, None, None, None), (1, None, 1.0, None)], SCHEMA)
    dc.put_days(spark, path, odd)
    assert dc.dataset_stats(spark, path).collect() == sp.dataset_stats(odd).collect()


def test_a_new_day_reads_no_other_day(spark):
    """The write that adds a day has no scan but that day's rows and its own key set."""
    path = scratch_path(spark, "days-alone")
    dc.create(spark.createDataFrame(rows(1, [1], 50), SCHEMA), path, buckets=64)
    from cinelytics.sources import tables as tb
    before = tb.read_commit(spark, path)["folders"]
    dc.put_days(spark, path, spark.createDataFrame(rows(2, [2], 50), SCHEMA))
    after = tb.read_commit(spark, path)["folders"]
    assert all(after[b] == f for b, f in before.items()) and len(after) == 2


def test_bitmaps_are_made_where_their_ids_are(spark):
    """No bitmap of a part of a day's rows is sent: the exchange lies below the aggregate's first half."""
    plan = dc.day_bitmaps(spark.createDataFrame(rows(1, [1, 2], 50), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    whole, partial = plan.index("bitmap_construct_agg("), plan.index("partial_bitmap_construct_agg(")
    assert whole < partial and "Exchange" not in plan[whole:partial]
    assert "hashpartitioning(day" in plan[partial:]
