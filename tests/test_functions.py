import math

from pyspark.sql import functions as F

from cinelytics.functions import columns as C
from cinelytics.operators import split as sp
from cinelytics.operators import evaluate as ev
from cinelytics.operators import model as mdl


def one(spark, expr, value, schema):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("v")).first()["v"]


def test_js_parse_int_prefix_semantics(spark):
    df = spark.createDataFrame([(x,) for x in ["4.7", " 12abc", "abc", "", None, "-3", "+5", "0"]], "x string")
    got = [r["v"] for r in df.select(C.js_parse_int("x").alias("v")).collect()]
    assert got == [4, 12, None, None, None, -3, 5, 0]


def test_to_fixed_treats_zero_and_null_as_missing(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, None, 3.5, 4.0, float("nan")]], "x double")
    got = [r["v"] for r in df.select(C.to_fixed_1("x").alias("v")).collect()]
    assert got == ["0.0", "0.0", "3.5", "4.0", "0.0"]


def test_genre_list_edges(spark):
    rows = [("",), (None,), ("Drama",), ("a, b ,c,  d , e",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r["v"] for r in df.select(C.genre_list("t", 3).alias("v")).collect()]
    assert got == [[], [], ["Drama"], ["a", "b", "c"]]
    full = [r["v"] for r in df.select(C.genre_list("t").alias("v")).collect()]
    assert full[3] == ["a", "b", "c", "d", "e"]


def test_nan_is_not_a_positive_prediction(spark):
    vals = [float("nan"), 0.0, -1.0, float("inf"), None, 3.5]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    kept = [r["p"] for r in df.where(C.is_positive_prediction("p")).collect()]
    assert kept == [3.5]
    # the trap itself: Spark SQL says NaN > 0
    assert df.where(F.col("p") > 0).count() == 3


def test_release_year_and_defaults(spark):
    df = spark.createDataFrame([(None, None, ""), ("1995-06-01", "x", "p")], "d string, name string, pic string")
    df = df.select(F.col("d").cast("date").alias("d"), "name", "pic")
    got = df.select(C.release_year("d").alias("y"), C.or_default("name", C.UNKNOWN_MOVIE).alias("n"),
                    C.poster("pic").alias("p")).collect()
    assert tuple(got[0]) == (C.UNKNOWN, C.UNKNOWN_MOVIE, C.NO_POSTER)
    assert tuple(got[1]) == ("1995", "x", "p")


def test_split_uses_truncated_remainder(spark):
    df = spark.createDataFrame([(ts,) for ts in [0, 5, 6, 7, 8, 9, -3, -8, 16]], "ts long")
    got = [r["split"] for r in sp.time_mod_split(df).collect()]
    assert got == ["train", "train", "validation", "validation", "test", "test", "train", "train", "validation"]


def test_split_is_a_partition(spark):
    df = spark.range(1000).select((F.col("id") * 7919 - 3000).alias("ts"))
    parts = [sp.split_part(df, p).count() for p in sp.SPLITS]
    assert sum(parts) == 1000


def test_split_counts_zero_fill_and_flags(spark):
    df = spark.createDataFrame([(8,), (9,)], "ts long")
    out = {r["split"]: (r["n_rows"], r["flagged"]) for r in sp.split_counts(sp.time_mod_split(df)).collect()}
    assert out == {"train": (0, True), "validation": (0, True), "test": (2, False)}


def test_positive_ratings_fails_when_empty(spark):
    df = spark.createDataFrame([(1, 2, 0.0)], "userid int, movieid int, rating double")
    try:
        sp.positive_ratings(df, require_nonempty=True)
    except ValueError:
        pass
    else:
        raise AssertionError("expected failure")


def test_rmse_ignores_non_finite_and_empty_is_max(spark):
    rows = [(float("nan"), 3.0), (4.0, 3.0), (float("inf"), 1.0), (2.0, 4.0)]
    df = spark.createDataFrame(rows, "prediction double, rating double")
    r = ev.rmse(df).first()
    assert math.isclose(r["rmse"], math.sqrt((1 + 4) / 2)) and r["n_pairs"] == 2
    empty = spark.createDataFrame([(float("nan"), 3.0)], "prediction double, rating double")
    assert ev.rmse(empty).first()["rmse"] == ev.DOUBLE_MAX


def test_pair_join_fans_out_duplicates(spark):
    pred = spark.createDataFrame([(1, 1, 3.0, 3.0), (1, 1, 3.0, 5.0)], "userid int, movieid int, prediction double, rating double")
    direct = ev.rmse(pred).first()
    joined = ev.rmse_pair_join(pred, pred).first()
    assert direct["n_pairs"] == 2 and joined["n_pairs"] == 4


def test_improvement_zero_baseline_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "b double, m double")
    got = [r["v"] for r in df.select(ev.improvement_pct("b", "m").alias("v")).collect()]
    assert got[0] is None and math.isclose(got[1], 50.0)


def _metrics(spark, rmses):
    rows = [(i, p.rank, float(p.reg), p.max_iter, r, "ok") for i, (p, r) in enumerate(zip(mdl.grid(), rmses))]
    return spark.createDataFrame(rows, "grid_order int, rank int, reg_param double, max_iter int, rmse double, status string")


def test_best_model_first_strict_minimum(spark):
    best = mdl.select_best_model(_metrics(spark, [2.0, 1.5, 1.5, 3.0, 9.0, 1.6, 2.0, 2.0])).first()
    assert best["grid_order"] == 1 and not best["is_fallback"]


def test_best_model_ignores_nan_inf_and_max(spark):
    vals = [float("nan"), float("inf"), ev.DOUBLE_MAX, 5.0, float("nan"), 4.0, float("inf"), 4.0]
    best = mdl.select_best_model(_metrics(spark, vals)).first()
    assert best["grid_order"] == 5


def test_best_model_fallback_when_nothing_valid(spark):
    vals = [float("nan"), float("inf"), ev.DOUBLE_MAX] * 2 + [float("nan"), float("nan")]
    best = mdl.select_best_model(_metrics(spark, vals)).first()
    assert best["is_fallback"] and (best["rank"], best["max_iter"], best["reg_param"]) == (10, 10, 0.01)


def test_recommended_conf_scales_with_input():
    from cinelytics.session import MAX_SHUFFLE_PARTITIONS, recommended_conf

    small = recommended_conf(10 ** 9, 8)
    big = recommended_conf(100 * 10 ** 12, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # two waves of tasks per core
    assert int(big["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
