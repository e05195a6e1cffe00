import json

from pyspark.sql import functions as F

from cinelytics.operators import catalog as cat
from cinelytics.operators import favorites as fav
from cinelytics.operators import ratings as rt
from cinelytics.operators import status as st
from cinelytics.session import scratch_path
from cinelytics.sources import tables as tb
from cinelytics.sources import text as tx


def subs(spark, bodies):
    rows = [(i, 7, f"2024-01-0{i + 1} 00:00:00", b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "submission_id long, userid int, ts string, selecteddata string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_json_submission_edge_cases(spark):
    bodies = ["[]", "not json", '[{"rating":3}]', '[{"movieid":1,"rating":"4.7"}]', '[{"movieid":2,"rating":5.5}]',
              '[{"movieid":"0","rating":3},{"movieid":0,"rating":3},{"movieid":"","rating":3}]', '{"movieid":1}']
    items = rt.validate_json_items(rt.parse_json_ratings(subs(spark, bodies)))
    got = sorted((r["submission_id"], r["pos"], r["parse_status"], r["accepted"], r["movieid"], r["rating"])
                 for r in items.collect())
    assert (0, None, "empty", False, None, None) in got
    assert (1, None, "malformed", False, None, None) in got
    assert (2, 0, "ok", False, None, 3) in got
    assert (3, 0, "ok", True, 1, 4) in got  # "4.7" -> 4
    assert (4, 0, "ok", False, 2, 5) in got  # 5.5 is out of range
    assert (5, 0, "ok", True, 0, 3) in got  # "0" is a non-empty string
    assert (5, 1, "ok", False, 0, 3) in got  # number 0 is falsy
    assert (5, 2, "ok", False, None, 3) in got
    assert (6, None, "malformed", False, None, None) in got


def test_pairs_and_zip(spark):
    df = spark.createDataFrame([(1, 7, "3:4, 5:1,,9:x")], "submission_id long, userid int, pairs string")
    got = [(r["pos"], r["movieid"], r["rating"]) for r in rt.parse_pair_ratings(df).orderBy("pos").collect()]
    assert got == [(0, 3, 4), (1, 5, 1), (3, 9, None)]
    z = spark.createDataFrame([(1, ["1", "2"], ["5", "4"]), (2, ["1"], [])], "id int, a array<string>, b array<string>")
    out = sorted((r["id"], r["lengths_match"], r["pos"], r["movieid"], r["moviescore"])
                 for r in rt.zip_scores(z, "a", "b").collect())
    assert out == [(1, True, 0, 1, 5), (1, True, 1, 2, 4), (2, False, None, None, None)]


def test_to_json_and_latest(spark):
    p = spark.createDataFrame([(1, 5, 3), (1, 2, 4)], "userid int, movieid int, rating int")
    doc = rt.to_json_ratings(p).first()["ratings_json"]
    assert json.loads(doc) == [{"movieid": 2, "rating": 4}, {"movieid": 5, "rating": 3}]
    s = subs(spark, ["[]", "[]", "[]"])
    latest = rt.latest_submission(s).first()
    assert latest["submission_id"] == 2 and latest["n_submissions"] == 3


def test_replace_deletes_even_without_accepted_items(spark):
    personal = spark.createDataFrame([(7, 1, 5, 0), (8, 2, 4, 0)], "userid int, movieid int, rating int, timestamp long")
    s = subs(spark, ['[{"movieid":3,"rating":9}]'])
    items = rt.valid_submissions(s)
    out = rt.replace_user_ratings(personal, s, items)
    assert [tuple(r) for r in out.collect()] == [(8, 2, 4, 0)]


def test_catalog_page_sorting_and_presets(spark):
    rows = [(i, f"m{i}", None if i % 4 == 0 else float(i % 5), i * 3) for i in range(1, 31)]
    c = spark.createDataFrame(rows, "movieid int, moviename string, averating double, numrating int")
    page = cat.catalog_page(c, page=1, sort="averating", order="asc", page_size=5).collect()
    assert [r["averating"] for r in page][:3] == [None] * 3  # NULLs first on ASC
    desc = cat.catalog_page(c, page="x", sort="bogus").collect()  # bad page -> 1, bad sort -> movieid DESC
    assert [r["movieid"] for r in desc][:3] == [30, 29, 28]
    pop = cat.catalog_page(c, sort="most_popular").first()
    assert pop["movieid"] == 30
    assert cat.title_search(c, "  ").count() == 30 and cat.title_search(c, "M1").count() == 11


def test_favorites_add_is_idempotent_and_remove_restores(spark):
    base = spark.createDataFrame([(1, 7, 10, "liked", "2024-01-01")],
                                 "id long, userid int, movieid int, category string, createtime string")
    base = base.withColumn("createtime", F.col("createtime").cast("timestamp_ntz"))
    req = spark.createDataFrame([(5, 7, 11, "", "2024-01-02"), (6, 7, 11, "liked", "2024-01-03"),
                                 (7, 7, 10, "liked", "2024-01-04"), (8, 7, 12, "bogus", "2024-01-05")],
                                "id long, userid int, movieid int, category string, createtime string")
    req = req.withColumn("createtime", F.col("createtime").cast("timestamp_ntz"))
    once, report = fav.favorites_add(base, req)
    twice, _ = fav.favorites_add(once, req)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert sorted((r["id"], r["already_exists"]) for r in report.collect()) == [(5, False), (6, True), (7, True)]
    removed = fav.favorites_remove(once, req.where("id = 5"))
    assert sorted(map(tuple, removed.collect())) == sorted(map(tuple, base.collect()))
    assert fav.favorites_by_category(once, "nope").count() == once.count()


def test_progress_monotone_and_status_fallbacks(spark):
    log = spark.createDataFrame([(1, 1, "2024-01-01 00:00:01", 5), (1, 2, "2024-01-01 00:00:02", 40),
                                 (1, 3, "2024-01-01 00:00:03", 20), (2, 4, "2024-01-01 00:00:01", -1)],
                                "userid int, event_id long, ts string, progress int")
    log = log.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("step", F.lit("s"))
    shown = [r["shown_progress"] for r in st.progress_monotone(log).orderBy("event_id").collect()]
    assert shown == [10, 40, 40, 10]
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 4, 5)], "userid int")
    recs = spark.createDataFrame([(3, 9)], "userid int, movieid int")
    ratings = spark.createDataFrame([(3, 1), (4, 1)], "userid int, movieid int")
    facts = st.user_facts(log, recs, ratings)
    out = {r["userid"]: (r["status"], r["progress"], r["rec_count"], r["failed"])
           for r in st.job_status(facts, users).collect()}
    assert out == {1: ("processing", 20, None, False), 2: ("processing", -1, None, True),
                   3: ("completed", 100, 1, False), 4: ("processing", 50, None, False),
                   5: ("no_data", 0, None, False)}
    simple = {r["userid"]: (r["status"], r["progress"]) for r in st.job_status_simple(facts).collect()}
    assert simple == {1: ("running", 20), 2: ("running", -1), 3: ("running", 0), 4: ("running", 0)}


def test_movies_dat_parsing(spark):
    path = scratch_path(spark, "movies-test")
    lines = ["1::Toy Story (1995)::Animation|Comedy", "2::A::B::C", '3::"Quoted" x::Drama', "4::only"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted(map(tuple, tx.read_movies(spark, path).collect()))
    assert got == [(1, "Toy Story (1995)", "Animation|Comedy"), (2, "A", "B"), (3, '"Quoted" x', "Drama"),
                   (4, "only", None)]


def test_encode_decode_round_trip_keeps_nulls_positional(spark):
    df = spark.createDataFrame([(1, None, 2.5, "t")], "u int, m int, r double, title string")
    enc = tx.encode_records(df, ["u", "m", "r", "title"])
    assert enc.first()["record"] == "1::::2.5::t"
    dec = tx.decode_records(enc, [("u", "int"), ("m", "int"), ("r", "double"), ("title", "string")]).first()
    assert tuple(dec) == (1, None, 2.5, "t")


def test_replace_by_key_twice_equals_once(spark):
    path = scratch_path(spark, "replace-test")
    old = spark.createDataFrame([(u, m, 1.0) for u in range(5) for m in range(3)], "userid int, movieid int, degree float")
    new = spark.createDataFrame([(1, 9, 5.0), (3, 8, 4.0)], "userid int, movieid int, degree float")
    tb.create_keyed_table(old, path, "userid", buckets=4)
    tb.replace_by_key(spark, path, new, "userid")
    first = sorted(map(tuple, tb.read_keyed_table(spark, path).collect()))
    tb.replace_by_key(spark, path, new, "userid")
    second = sorted(map(tuple, tb.read_keyed_table(spark, path).collect()))
    assert first == second
    assert [r for r in first if r[0] in (1, 3)] == [(1, 9, 5.0), (3, 8, 4.0)]
    assert len(first) == 3 * 3 + 2


def test_movies_in_list_skips_blank_ids(spark):
    catalog = spark.createDataFrame([(i, f"m{i}", None) for i in range(1, 8)], "movieid int, moviename string, picture string")
    reqs = spark.createDataFrame([(1, "1,2,,5"), (2, " 3 , x,"), (3, "")], "rid int, ids string")
    got = sorted((r["rid"], r["movieid"]) for r in cat.movies_in_list(reqs, "ids", catalog).collect())
    assert got == [(1, 1), (1, 2), (1, 5), (2, 3)]


def test_read_rows_for_keys_prunes_and_handles_empty_sets(spark):
    path = scratch_path(spark, "keyed-read-test")
    rows = spark.createDataFrame([(u, m) for u in range(20) for m in range(3)], "userid int, movieid int")
    tb.create_keyed_table(rows, path, "userid", buckets=8)
    want = spark.createDataFrame([(3,), (17,), (99,)], "userid int")
    got = sorted(map(tuple, tb.read_rows_for_keys(spark, path, want, "userid").collect()))
    assert got == [(3, 0), (3, 1), (3, 2), (17, 0), (17, 1), (17, 2)]
    none = spark.createDataFrame([], "userid int")
    assert tb.read_rows_for_keys(spark, path, none, "userid").count() == 0


def test_malformed_bodies_never_replace(spark):
    subs = spark.createDataFrame(
        [(1, 7, 10, '[{"movieid":1,"rating":4}]'), (2, 7, 20, "not json"), (3, 7, 30, "[]"), (4, 8, 10, "{}"), (5, 9, 10, None),
         (6, 6, 10, '[{"movieid":1,"rating":9}]')], "submission_id int, userid int, ts int, selecteddata string")
    latest = rt.latest_submission(rt.well_formed(subs))
    assert sorted((r["userid"], r["submission_id"]) for r in latest.collect()) == [(6, 6), (7, 1)]


def test_repeated_ids_numbers_pages_and_nan(spark):
    from pyspark.sql import functions as F

    from cinelytics.functions import columns as C
    from cinelytics.operators import catalog, favorites, split

    ids = catalog.ids_from_list(spark.createDataFrame([("5, 5,6,,x",)], "l string"), "l")
    assert sorted(r["movieid"] for r in ids.collect()) == [5, 6]
    nums = spark.createDataFrame([("4",), ("4d",), ("4f",), ("",), (" 3.5 ",), ("1e1",), ("x",)], "s string")
    assert [r[0] for r in nums.select(C.js_to_number("s")).collect()] == [4.0, None, None, 0.0, 3.5, 10.0, None]
    films = spark.range(60).select(F.col("id").cast("int").alias("movieid"), F.lit(1.0).alias("averating"), F.lit(1).alias("numrating"),
                                   F.lit(None).cast("date").alias("releasetime"))
    for page in ("2abc", "2.7", 2):
        assert min(r["movieid"] for r in catalog.catalog_page(films, page).collect()) == min(
            r["movieid"] for r in catalog.catalog_page(films, 2).collect())
    rated = spark.createDataFrame([(float("nan"),), (1.0,), (0.0,)], "rating double")
    assert split.positive_ratings(rated).count() == 1
    fav = spark.createDataFrame([(1, "liked"), (1, "other")], "userid int, category string")
    assert favorites.favorites_count(fav).first()["total"] == 2


def test_first_favourite_request_is_one_row(spark):
    from cinelytics.operators import favorites as fav

    none = spark.createDataFrame([], "id int, userid int, movieid int, category string, createtime string")
    asked = spark.createDataFrame([(5, 1, 2, "liked", "2024-01-02"), (9, 1, 2, "liked", "2024-01-01")], none.schema)
    table, report = fav.favorites_add(none, asked)
    assert [(r["id"], r["createtime"]) for r in table.collect()] == [(9, "2024-01-01")]
    assert {r["id"]: r["already_exists"] for r in report.collect()} == {5: True, 9: False}


def test_status_steps_and_messages(spark):
    facts = spark.createDataFrame(
        [(1, 100, None, 7, 0), (2, 40, "", 0, 0), (3, 40, "fit", 0, 0), (4, None, None, 2, 1), (5, None, None, 0, 3),
         (6, None, None, 0, 0)], "userid int, progress int, step string, n_recs long, n_ratings long")
    got = {r["userid"]: (r["step"], r["message"]) for r in st.job_status(facts).collect()}
    assert got == {
        1: ("推荐已生成", "推荐已生成，共 7 部电影"), 2: ("正在计算推荐", "正在生成推荐，请稍候..."), 3: ("fit", "fit"),
        4: ("推荐已生成", "推荐已生成，共 2 部电影"), 5: ("正在计算推荐", "正在生成推荐，请稍候..."),
        6: ("等待评分数据", "暂无评分数据")}
    simple = {r["userid"]: r["message"] for r in st.job_status_simple(facts).collect()}
    assert (simple[3], simple[6]) == ("fit", "初始化 Spark 推荐引擎...")


def test_mean_with_one_decimal_rounds_like_to_fixed(spark):
    from cinelytics.functions import columns as C

    want = {2.25: "2.3", 2.75: "2.8", 2.5: "2.5", 1.45: "1.4", 1.35: "1.4", 3.0: "3.0", 10 / 3: "3.3", 4.96: "5.0",
            None: "0.0"}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r[0]: r[1] for r in df.select("x", C.mean_to_fixed_1("x")).collect()} == want


def test_left_joins_keep_movies_outside_the_catalog(spark):
    catalog = spark.createDataFrame(
        [(1, "One", "p", 3.5, 7, "Drama", None, "D")],
        "movieid int, moviename string, picture string, averating double, numrating int, typelist string, "
        "releasetime date, director string")
    personal = spark.createDataFrame([(9, 1, 4, 5), (9, 2, 3, 6)], "userid int, movieid int, rating int, timestamp long")
    shown = {r["movie_id"]: (r["movie_name"], r["average_rating"], r["rating_count"], r["genres"], r["director"])
             for r in rt.history_display(rt.rating_history(personal, catalog)).collect()}
    assert shown == {1: ("One", "3.5", 7, "Drama", "D"), 2: ("未知电影", "0.0", 0, "", "未知")}
    favs = spark.createDataFrame([(1, 9, 2, "liked", None, "n")],
                                 "id int, userid int, movieid int, category string, rating int, note string")
    row = fav.favorites_list(favs, catalog).first()
    assert (row["moviename"], row["rating"], row["note"]) == (None, None, "n")


def test_users_without_ratings_get_a_zero_row(spark):
    personal = spark.createDataFrame([(1, 2), (1, 5)], "userid int, rating int")
    users = spark.createDataFrame([(1,), (2,)], "userid int")
    got = {r["userid"]: (r["total_ratings"], r["avg_text"], r["n_2"], r["n_5"])
           for r in rt.rating_stats(personal, users).collect()}
    assert got == {1: (2, "3.5", 1, 1), 2: (0, "0.0", 0, 0)}


def test_submission_outcomes(spark):
    bodies = ["not json", "[]", '[{"movieid":1,', '{"movieid":1,"rating":3}', '[{"movieid":0,"rating":3}]',
              '[{"movieid":1,"rating":3},{"movieid":2,"rating":9}]', None]
    subs = spark.createDataFrame(list(enumerate(bodies)), "submission_id int, selecteddata string").withColumn(
        "userid", F.lit(1))
    got = {r["submission_id"]: (r["http_status"], r["n_accepted"], r["n_rejected"])
           for r in rt.submission_outcome(subs).collect()}
    assert got == {0: (400, 0, 0), 1: (400, 0, 0), 2: (400, 0, 0), 3: (400, 0, 0), 4: (500, 0, 1), 5: (200, 1, 1),
                   6: (400, 0, 0)}


def test_deep_catalog_page_equals_shallow(spark):
    films = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(200)],
                                  "movieid int, averating double")
    for page in (1, 4, 9, 40):
        a = cat.catalog_page(films, page, "averating", "asc").collect()
        b = cat.catalog_page(films, page, "averating", "asc", shallow_rows=0).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
