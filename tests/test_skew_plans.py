"""The skew-safe plan helpers against plain brute force, with one hot key that
holds a third of the rows and with the broadcast bound forced to zero so the
salted shuffle path runs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinelytics.operators import recommend as rec
from cinelytics.plans.joins import join_dimension
from cinelytics.plans.ranking import global_rank, row_number_within, running_max_within


def _skewed_rows(n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rnd.randint(1, 40)  # user 0 holds a third
        rows.append((user, i, rnd.randint(-1, 30), rnd.randint(0, 50)))
    return rows


def test_join_dimension_shuffled_equals_broadcast(spark):
    fact = spark.createDataFrame(_skewed_rows(), "userid int, seq int, v int, item int")
    dim = spark.createDataFrame([(u, f"u{u}") for u in range(0, 41, 2)], "userid int, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, join_dimension(fact, dim, "userid", how, max_rows=0).collect()))
        b = sorted(map(tuple, fact.join(dim, "userid", how).collect()))
        assert a == b, how


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(300)], "id int, score int")
    ranked = global_rank(df, [F.desc("score"), F.asc("id")], "r", num_partitions=7).collect()
    by_rank = sorted(ranked, key=lambda r: r["r"])
    assert [r["r"] for r in by_rank] == list(range(1, 301))
    expect = sorted(((-r["score"], r["id"]) for r in ranked))
    assert [(-r["score"], r["id"]) for r in by_rank] == expect


def test_row_number_within_matches_window(spark):
    df = spark.createDataFrame(_skewed_rows(), "userid int, seq int, v int, item int")
    got = row_number_within(df, ["userid"], [F.desc("v"), F.asc("seq")], "rn", num_partitions=6)
    w = Window.partitionBy("userid").orderBy(F.desc("v"), F.asc("seq"))
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_running_max_within_matches_window(spark):
    df = spark.createDataFrame(_skewed_rows(), "userid int, seq int, v int, item int")
    got = running_max_within(df, ["userid"], [F.asc("seq")], "v", "m", num_partitions=6)
    w = Window.partitionBy("userid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("m", F.max("v").over(w))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_top_unseen_per_user_matches_brute_force(spark):
    rnd = random.Random(11)
    items = list(range(1, 61))
    scores = [(i, float(rnd.choice([0.0, -1.0, 1.0, 2.0, 2.5, 3.0, 4.0, float("nan")]))) for i in items]
    seen = []
    for u in range(8):
        k = 55 if u == 0 else rnd.randint(0, 20)  # user 0 has seen almost everything
        seen += [(u, i) for i in rnd.sample(items, k)]
        seen += [(u, seen[-1][1])] if k else []  # a duplicate pair
    users = spark.createDataFrame([(u,) for u in range(10)], "userid int")  # 8, 9 have seen nothing
    sdf = spark.createDataFrame(seen, "userid int, movieid int")
    cdf = spark.createDataFrame(scores, "movieid int, prediction double")
    got = rec.top_unseen_per_user(users, sdf, cdf, n=10)
    got = sorted((r["userid"], r["rank"], r["movieid"]) for r in got.collect())
    valid = sorted(((s, i) for i, s in scores if s == s and s > 0), key=lambda t: (-t[0], t[1]))
    want = []
    for u in range(10):
        mine = {i for uu, i in seen if uu == u}
        best = [i for _, i in valid if i not in mine][:10]
        want += [(u, k + 1, i) for k, i in enumerate(best)]
    assert got == sorted(want)


def test_unseen_candidate_counts(spark):
    users = spark.createDataFrame([(1,), (2,)], "userid int")
    seen = spark.createDataFrame([(1, 1), (1, 1), (1, 99)], "userid int, movieid int")
    cat = spark.createDataFrame([(1,), (2,), (3,)], "movieid int")
    out = {r["userid"]: (r["n_rated_in_catalog"], r["n_candidates"])
           for r in rec.unseen_candidate_counts(users, seen, cat).collect()}
    assert out == {1: (1, 2), 2: (0, 3)}


def _brute_top_unseen(users, seen, scores, n):
    valid = sorted(((s, i) for i, s in scores if s == s and s > 0), key=lambda t: (-t[0], t[1]))
    out = []
    for u in users:
        mine = {i for uu, i in seen if uu == u}
        best = [i for _, i in valid if i not in mine][:n]
        out += [(u, k + 1, i) for k, i in enumerate(best)]
    return sorted(out)


def test_top_unseen_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    score = st.sampled_from([0.0, -2.0, 1.0, 1.5, 3.0, 3.0, 4.5, float("nan")])

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(
        scores=st.lists(score, min_size=1, max_size=25),
        seen=st.lists(st.tuples(st.integers(0, 4), st.integers(1, 30)), max_size=60),
        n=st.integers(1, 6),
    )
    def check(scores, seen, n):
        items = [(i + 1, s) for i, s in enumerate(scores)]
        users = sorted({u for u, _ in seen} | {5})
        udf = spark.createDataFrame([(u,) for u in users], "userid int")
        sdf = spark.createDataFrame(seen or [(0, 999)], "userid int, movieid int")
        cdf = spark.createDataFrame(items, "movieid int, prediction double")
        got = sorted((r["userid"], r["rank"], r["movieid"])
                     for r in rec.top_unseen_per_user(udf, sdf, cdf, n=n).collect())
        assert got == _brute_top_unseen(users, seen or [(0, 999)], items, n)

    check()


def test_top_unseen_over_several_blocks(spark):
    """Catalogs of many 64-rank blocks: users that saw a whole prefix, whole middle blocks, only far
    ranks, or nothing of the catalog; n above and below the block width."""
    scores = [(i, float(1000 - i)) for i in range(1, 400)]
    seen = [(1, i) for i in range(1, 330)] + [(2, i) for i in range(65, 193)] + [(3, 390)] + [(4, 9999)]
    seen += [(5, i) for i in range(1, 400)] + [(6, i) for i in range(1, 400, 2)] + [(2, 70)]
    sdf = spark.createDataFrame(seen, "userid int, movieid int")
    cdf = spark.createDataFrame(scores, "movieid int, prediction double")
    for n in (1, 10, 64, 130):
        got = sorted((r["userid"], r["rank"], r["movieid"]) for r in rec.top_unseen_per_user(None, sdf, cdf, n=n).collect())
        assert got == _brute_top_unseen(range(1, 7), seen, scores, n), n


def test_broadcast_needs_rows_and_bytes_within_bounds(spark):
    from cinelytics.plans.joins import fits_broadcast

    dim = spark.range(100).select("id", F.lit("x" * 1000).alias("text"))
    assert fits_broadcast(dim) and not fits_broadcast(dim, max_rows=99)
    assert not fits_broadcast(dim, max_bytes=100_000) and fits_broadcast(dim, max_bytes=102_000)
    assert not fits_broadcast(dim, known_rows=100, max_bytes=100_000)
    assert fits_broadcast(dim.select("id"), known_rows=100, max_bytes=800)
