from pyspark.sql import functions as F

from cinelytics import queries as Q
from cinelytics.operators import model as mdl

from .conftest import SF_SMALL


def test_grid_order_is_rank_lambda_iterations():
    g = mdl.grid()
    assert [(p.rank, p.reg, p.max_iter) for p in g[:3]] == [(8, 0.1, 10), (8, 0.1, 20), (8, 10.0, 10)]
    assert len(g) == 8


def test_recommend_for_users_matches_brute_force(spark):
    training = Q._training(spark, SF_SMALL)
    model = mdl.als_fit(training, mdl.AlsParams(8, 0.1, 5))
    seen = Q._seen(spark, SF_SMALL)
    catalog = Q.V(spark, SF_SMALL, "movieinfo_v")
    users = seen.select("userid").distinct()
    got = mdl.recommend_for_users(model, users, seen, catalog, n=10)
    got_sets = {}
    for r in got.collect():
        got_sets.setdefault(r["userid"], set()).add(r["movieid"])
    # brute force: every user x catalog pair scored by transform (fine at this size)
    pairs = users.crossJoin(catalog.select("movieid"))
    scored = model.transform(pairs).join(seen.distinct(), ["userid", "movieid"], "left_anti")
    scored = scored.where(~F.isnan("prediction") & (F.col("prediction") > 0)).collect()
    by_user = {}
    for r in scored:
        by_user.setdefault(r["userid"], []).append((-r["prediction"], r["movieid"]))
    checked = 0
    for u, lst in by_user.items():
        lst.sort()
        top = lst[:10]
        if len(lst) > 10 and abs(lst[9][0] - lst[10][0]) < 1e-4:
            continue  # near-tie at the cut: float order may differ between the two scorers
        assert got_sets.get(u, set()) == {m for _, m in top}, u
        checked += 1
    assert checked > 0.8 * len(by_user)


def test_als_rejects_ids_beyond_32_bits(spark):
    import pytest

    df = spark.createDataFrame([(1, 2, 3.0), (2, 3_000_000_000, 4.0)], "userid long, movieid long, rating double")
    with pytest.raises(Exception, match="32-bit"):
        mdl.als_fit(df, mdl.AlsParams(2, 0.1, 1))


def test_grid_choice_report_and_single_user_flow(spark):
    """Small grid with a failing cell: tolerated with its message, the first minimum chosen, the report
    consistent, and the single-user list equal to brute force."""
    training, validation = Q._training(spark, SF_SMALL), Q._validation(spark, SF_SMALL)
    cells = [mdl.AlsParams(-1, 0.1, 2), mdl.AlsParams(4, 10.0, 2), mdl.AlsParams(4, 0.1, 3)]
    metrics, models = mdl.als_grid_search(training, validation, cells, keep_models=True)
    rows = {r["grid_order"]: r for r in metrics.collect()}
    assert rows[0]["status"] == "failed" and rows[0]["error"] and rows[0]["rmse"] != rows[0]["rmse"]
    known_u = {r[0] for r in training.select("userid").distinct().collect()}
    known_m = {r[0] for r in training.select("movieid").distinct().collect()}
    pairs = [(r["userid"], r["movieid"]) for r in validation.collect()]
    warm = sum(u in known_u and m in known_m for u, m in pairs)
    assert 0 < warm < len(pairs)  # the split leaves cold pairs
    assert [rows[i]["n_pairs"] for i in (1, 2)] == [warm, warm]

    best = mdl.select_best_model(metrics)
    chosen = best.first()
    assert chosen["grid_order"] == min((1, 2), key=lambda i: (rows[i]["rmse"], i)) and not chosen["is_fallback"]
    report = mdl.model_report(best, 1.5, 2.0).first()
    assert (report["rank"], report["validation_rmse"]) == (4, chosen["rmse"])
    assert abs(report["improvement_pct"] - 25.0) < 1e-9

    model = models[chosen["grid_order"]]
    catalog, seen = Q.V(spark, SF_SMALL, "movieinfo_v"), Q._own_seen(spark, SF_SMALL)
    user = Q._most_active_user(spark, SF_SMALL)
    got = mdl.recommend_for_user(model, user, catalog, seen).collect()
    rated = {r["movieid"] for r in seen.where(F.col("userid") == user).collect()}
    ids = [r["movieid"] for r in catalog.collect()]
    scored = {r["movieid"]: r["prediction"] for r in model.transform(
        spark.createDataFrame([(user, m) for m in ids], "userid int, movieid int")).collect()}
    want = sorted((-p, m) for m, p in scored.items() if m not in rated and p > 0)[:10]
    assert len(got) == 10 and {r["movieid"] for r in got} == {m for _, m in want}


def test_no_valid_cell_falls_back(spark):
    none = spark.createDataFrame([(0, 8, 0.1, 10, float("nan"), 0, "failed", "x")], mdl.METRICS_SCHEMA)
    chosen = mdl.select_best_model(none).first()
    assert chosen["is_fallback"] and (chosen["rank"], chosen["max_iter"], chosen["reg_param"]) == (10, 10, 0.01)


def test_block_count_follows_the_rows():
    assert mdl.block_count(0) == 10 and mdl.block_count(0, cores=8) == 8
    assert mdl.block_count(25_000_000, cores=8) == 25 and mdl.block_count(0, cores=8_000) == 10
    assert mdl.block_count(10 ** 13) == 1_000


def test_failed_job_logs_minus_one_and_keeps_results(spark):
    import pytest

    from cinelytics.operators import job
    from cinelytics.session import scratch_path
    from cinelytics.sources import tables as tb

    results, log = scratch_path(spark, "job-results"), scratch_path(spark, "job-log")
    users = spark.createDataFrame([(1,), (2,)], "userid int")
    stored = spark.createDataFrame([(1, 5, 2.0), (3, 6, 1.0)], "userid int, movieid int, degree float")
    tb.create_keyed_table(stored, results, "userid")
    tb.create_keyed_table(job.progress_rows(users, 5, 0), log, "userid")
    own = spark.createDataFrame([(1, 5, 0)], "userid int, movieid int, rating int")  # nothing rated
    sample = spark.createDataFrame([(9, 5, 3.0, 1)], "userid int, movieid int, rating double, ts long")
    with pytest.raises(ValueError, match="No ratings"):
        job.run_job(users, own, sample, spark.createDataFrame([(5, "a")], "movieid int, moviename string"), results, log)
    rows = tb.read_keyed_table(spark, log).orderBy("userid", "event_id").collect()
    assert [r["progress"] for r in rows if r["userid"] == 1] == [5, 5, 20, -1]
    assert tb.read_keyed_table(spark, results).count() == 2


def test_first_job_on_an_empty_store(spark):
    """No table of results or progress yet: the job creates both and ends at 100."""
    from cinelytics.operators import job
    from cinelytics.session import scratch_path
    from cinelytics.sources import tables as tb

    results, log = scratch_path(spark, "first-results"), scratch_path(spark, "first-log")
    rows = [(u, m, float((u * m) % 5 + 1), 10 * u + m % 8) for u in range(20, 40) for m in range(30)]
    sample = spark.createDataFrame(rows, "userid int, movieid int, rating double, ts long")
    own = spark.createDataFrame([(1, m, m % 5 + 1) for m in range(8)], "userid int, movieid int, rating int")
    catalog = spark.createDataFrame([(m, f"m{m}") for m in range(30)], "movieid int, moviename string")
    users = own.select("userid").distinct()
    job.run_job(users, own, sample, catalog, results, log, [mdl.AlsParams(2, 0.1, 2), mdl.AlsParams(3, 0.1, 2)])
    got = tb.read_keyed_table(spark, results).collect()
    assert len(got) == 10 and not {r.movieid for r in got} & set(range(8))
    assert tb.read_keyed_table(spark, log).agg(F.max_by("progress", "event_id")).first()[0] == 100


def test_stored_grid_reads_back(spark, tmp_path):
    rows = [(u, m, float((u + m) % 5 + 1)) for u in range(12) for m in range(12)]
    train = spark.createDataFrame(rows, "userid int, movieid int, rating double")
    metrics, models = mdl.als_grid_search(train, train, [mdl.AlsParams(2, 0.1, 1), mdl.AlsParams(-1, 0.1, 1)], keep_models=True)
    mdl.store_grid(metrics, models, str(tmp_path / "grid"))
    again, loaded = mdl.load_grid(spark, str(tmp_path / "grid"))
    assert sorted(map(str, again.collect())) == sorted(map(str, metrics.collect()))
    assert list(loaded) == [0] and loaded[0].rank == 2


def test_a_fit_holds_no_shuffle_files(spark):
    """The model is read from files, so its fit's shuffles and cached blocks can go; the iterations'
    go at every second one."""
    rows = [(u, m, float((u + m) % 5 + 1)) for u in range(12) for m in range(12)]
    train = spark.createDataFrame(rows, "userid int, movieid int, rating double")
    model = mdl.als_fit(train, mdl.AlsParams(2, 0.1, 3))
    assert model.userFactors.inputFiles() and model.itemFactors.inputFiles()
    assert mdl.CHECKPOINT_INTERVAL <= 2
    _, models = mdl.als_grid_search(train, train, [mdl.AlsParams(2, 0.1, 1), mdl.AlsParams(3, 0.1, 1)], keep_models=True)
    assert all(m.userFactors.inputFiles() for m in models.values())


def test_fits_use_few_blocks(spark, monkeypatch):
    train = spark.range(100).selectExpr("CAST(id AS int) AS userid", "CAST(id AS int) AS movieid", "1.0F AS rating")
    cores = spark.sparkContext.defaultParallelism
    assert mdl.als_blocks(train) == max(2, min(6, cores)) and mdl.als_blocks(train, at_once=cores) == 2
    monkeypatch.setattr(mdl, "FIT_ROWS_PER_BLOCK", 9)
    assert mdl.als_blocks(train) == 12
