"""Tables in shared buckets: equal to the plain plans with hot, null and unmatched keys, no
exchange for the others, opened again, empty tables, a write that broke off."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cinelytics.operators import status as st
from cinelytics.plans.joins import join_in_place
from cinelytics.sources.colocated import open_colocated, write_colocated


@pytest.fixture()
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def tables(spark, n=600, seed=3):
    rng = random.Random(seed)

    def user():  # user 7 holds a third of all rows
        return 7 if rng.random() < 0.33 else rng.choice([None, *range(40)])

    log = [(user(), i, i % 5, rng.choice([5, 50, 100, -1]), rng.choice(["", "x", None])) for i in range(n)]
    frames = {
        "progress": spark.createDataFrame([r for r in log if r[0] is None or r[0] < 25], "userid int, event_id int, ts int, progress int, step string"),
        "recs": spark.createDataFrame([(user(), i) for i in range(n // 3)], "userid int, movieid int"),
        "ratings": spark.createDataFrame([(user(), i) for i in range(n)], "userid int, movieid int"),
    }
    users = spark.createDataFrame([(u,) for u in range(45)], "userid int")
    return {**frames, "users": users}


def facts(t):
    return st.user_facts_of(t["users"], t["progress"], t["recs"], t["ratings"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_in_place_equals_the_plain_plan(spark, tmp_path, no_auto_broadcast):
    t = tables(spark)
    stored = write_colocated(t, "userid", str(tmp_path / "t"), rows_per_bucket=60)
    assert stored.has_hot and {r[0] for r in stored.hot()["ratings"].select("userid").distinct().collect()} == {7}
    assert rows(stored.per_key(facts)) == rows(facts(t))
    # the users of the plain facts that the list holds
    plain = st.user_facts(t["progress"], t["recs"], t["ratings"])
    assert rows(stored.per_key(facts).where("progress IS NOT NULL")) == rows(plain.join(t["users"], "userid", "left_semi").where("progress IS NOT NULL"))
    assert rows(stored.per_key(lambda s: st.job_status(facts(s)))) == rows(st.job_status(facts(t)))
    again = open_colocated(spark, str(tmp_path / "t"))
    assert rows(again.per_key(facts)) == rows(facts(t))


def test_cold_rows_need_no_exchange(spark, tmp_path, no_auto_broadcast):
    t = tables(spark)
    stored = write_colocated(t, "userid", str(tmp_path / "t"), rows_per_bucket=60)
    assert "Exchange" in plan(facts(t)) and "Exchange" not in plan(facts(stored.cold()))
    assert "SortMergeJoin" in plan(facts(stored.cold()))
    # buckets of one file each, so a bucket's rows are read by one task
    cold = stored.cold()["ratings"]
    assert cold.select("userid", F.input_file_name().alias("f")).groupBy("userid").agg(F.countDistinct("f").alias("n")).where("n > 1").count() == 0
    assert cold.count() + stored.hot()["ratings"].count() == t["ratings"].count()


def test_left_join_in_place(spark, tmp_path, no_auto_broadcast):
    rng = random.Random(5)
    fact = spark.createDataFrame([(1 if rng.random() < 0.4 else rng.choice([None, *range(30)]), i) for i in range(300)], "movieid int, n int")
    dim = spark.createDataFrame([(m, f"t{m}") for m in range(20)], "movieid int, title string")
    stored = write_colocated({"fact": fact, "dim": dim}, "movieid", str(tmp_path / "t"), rows_per_bucket=40)

    def joined(t):
        return join_in_place(t["fact"], t["dim"], "movieid", "left")

    assert stored.has_hot and rows(stored.per_key(joined)) == rows(fact.join(dim, "movieid", "left"))
    assert "Exchange" not in plan(joined(stored.cold()))


def test_hot_null_key(spark, tmp_path):
    fact = spark.createDataFrame([(None if i < 50 else i, i) for i in range(80)], "k int, n int")
    stored = write_colocated({"fact": fact}, "k", str(tmp_path / "t"), rows_per_bucket=20)
    assert stored.hot()["fact"].count() == 50
    counts = stored.per_key(lambda t: t["fact"].groupBy("k").agg(F.count("*").alias("c")))
    assert rows(counts) == rows(fact.groupBy("k").agg(F.count("*").alias("c")))


def test_empty_tables_and_odd_names(spark, tmp_path):
    empty = spark.createDataFrame([], "`k` int, `a b` string, `x``y` int")
    other = spark.createDataFrame([(1, 2)], "k int, __n int")
    stored = write_colocated({"empty": empty, "other": other}, "k", str(tmp_path / "t"))
    both = stored.per_key(lambda t: t["other"].join(t["empty"], "k", "left"))
    assert both.columns == ["k", "__n", "a b", "x`y"] and rows(both) == [(1, 2, None, None)]
    assert all(df.count() == 0 for df in stored.hot().values())


def test_a_write_that_broke_off_cannot_be_opened(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t" / "cold" / "a"))
    with pytest.raises(AnalysisException):
        open_colocated(spark, str(tmp_path / "t"))


def test_key_types_must_agree(spark, tmp_path):
    with pytest.raises(ValueError):
        write_colocated({"a": spark.range(3), "b": spark.range(3).selectExpr("cast(id as int) id")}, "id", str(tmp_path / "t"))
