"""The norm-bounded search against brute force."""

import numpy as np
import pytest

from cinelytics.operators import mips


def brute(users, items, seen, n):
    out = []
    for u, f in users.items():
        scored = [(-np.float32(np.dot(np.float64(f), np.float64(g))), i) for i, g in items.items() if (u, i) not in seen]
        out += [(u, i, k + 1) for k, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:n])]
    return sorted(out)


def frames(spark, users, items, seen):
    schema = "id int, features array<float>"
    return (spark.createDataFrame([(u, [float(x) for x in f]) for u, f in users.items()], schema),
            spark.createDataFrame([(i, [float(x) for x in f]) for i, f in items.items()], schema),
            spark.createDataFrame(sorted(seen, key=str), "userid int, movieid int"))


def case(seed, n_users, n_items, rank=4):
    rng = np.random.default_rng(seed)
    # small whole numbers: many equal scores, exact in floats
    users = {u: rng.integers(-2, 4, rank).astype(np.float32) for u in range(n_users)}
    items = {100 + i: rng.integers(-2, 4, rank).astype(np.float32) * (1 + i % 3) for i in range(n_items)}
    seen = {(int(u), 100 + int(i)) for u, i in zip(rng.integers(0, n_users, 40 * n_users), rng.integers(0, n_items, 40 * n_users))}
    return users, items, seen


@pytest.mark.parametrize("round_bytes,block", [(64 * 48, 16), (1 << 20, 50), (1 << 20, 2_048)])
def test_equals_brute_force(spark, round_bytes, block):
    users, items, seen = case(block, 60, 400)
    users[7], users[8] = np.zeros(4, np.float32), -np.ones(4, np.float32)
    seen |= {(3, i) for i in items} | {(9, 100 + i) for i in range(395)}  # one has seen all, one all but five
    odd = [(1, None), (None, 100), (999, 100), (1, 99_999)]
    got = mips.best_unseen(*frames(spark, users, items, [*seen, *odd, *list(seen)[:50]]), 10, round_bytes=round_bytes, block=block)
    assert got.columns == ["userid", "movieid", "prediction", "rank"]
    rows = got.collect()
    assert sorted((r.userid, r.movieid, r["rank"]) for r in rows) == brute(users, items, seen, 10)
    assert all(r.prediction == np.float32(users[r.userid] @ items[r.movieid]) for r in rows)


def test_a_user_with_many_seen_items(spark):
    """100,000 seen ids of one user: words a row each, no array longer than n."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    items = {i: rng.normal(size=3).astype(np.float32) for i in range(100_400)}
    users = {1: np.float32([1, 2, 3]), 2: np.float32([-1, .5, 0])}
    users_f, items_f, _ = frames(spark, users, items, {(0, 0)})
    seen = spark.range(100_000).select(F.lit(1).alias("userid"), F.col("id").cast("int").alias("movieid"))
    got = mips.best_unseen(users_f, items_f, seen, 10, round_bytes=1 << 21).collect()
    want = []
    for u, f in users.items():
        ids = [i for i in items if u == 2 or i >= 100_000]
        scores = (np.stack([items[i] for i in ids]).astype(np.float64) @ f.astype(np.float64)).astype(np.float32)
        best = sorted(zip(-scores, ids))[:10]
        want += [(u, i, k + 1) for k, (s, i) in enumerate(best) if s < 0]
    assert sorted((r.userid, r.movieid, r["rank"]) for r in got) == sorted(want)


def test_bound_ends_the_search():
    """Falling norms: after the first block nothing can beat what was found."""
    rng = np.random.default_rng(2)
    items = rng.normal(size=(5_000, 4)) * np.r_[np.full(100, 100.0), np.full(4_900, 0.01)][:, None]
    norms = np.sqrt((items * items).sum(axis=1))
    order = np.argsort(-norms)
    none = np.zeros(0, np.int64)
    users = rng.normal(size=(20, 4))
    (u, ids, scores), made = mips.best_of_blocks(users, (none, none, np.zeros(0, np.float32)), none, none, items[order],
                                                 np.arange(5_000)[order], norms[order], 10, block=100)
    full = (users @ items.T).astype(np.float32)
    for k in range(20):
        assert sorted(zip(-full[k], range(5_000)))[:10] == list(zip(-scores[u == k], ids[u == k]))
    assert made == 20 * 100


def test_empty_inputs(spark):
    users, items, seen = frames(spark, {1: [1.0]}, {2: [1.0]}, {(1, 2)})
    assert mips.best_unseen(users, items, seen, 10).count() == 0
    assert mips.best_unseen(users, items.limit(0), seen, 10).count() == 0
    assert mips.best_unseen(users.limit(0), items, seen, 10).count() == 0
    assert [tuple(r) for r in mips.best_unseen(users, items, seen.limit(0), 10).collect()] == [(1, 2, 1.0, 1)]


def test_words_of_users_without_a_state_are_left_out():
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())],
                                          names=["userid", "kind"])

    def left(rows, last):
        b, after = mips.known_users(batch(rows), last)
        return list(zip(*(c.to_pylist() for c in b.columns))), after

    assert left([(1, 1), (2, 0), (2, 1), (3, 1)], None) == ([(2, 0), (2, 1)], 2)
    assert left([(2, 1), (2, 1), (3, 1)], 2) == ([(2, 1), (2, 1)], 2)  # a user over two batches
    assert left([(3, 1), (4, 0), (4, 1), (5, 0)], 2) == ([(4, 0), (4, 1), (5, 0)], 5)
    assert left([(7, 1)], None) == ([], None) and left([], 3) == ([], 3)
