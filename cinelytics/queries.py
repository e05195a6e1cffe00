"""The registered queries: one per operator, run over whole fixture views.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the raw tables, with the fixture views as CTEs).  Single-user operators
run here in their all-users form so that the work is distributed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions.columns import is_positive_prediction
from .operators import distinct as dc
from .operators import evaluate as ev
from .operators import model as mdl
from .operators import recommend as rec
from .operators import split as sp
from .session import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


def V(spark, d, name):
    return fx.view(spark, d, name)


# ----------------------------------------------------------- shared pieces --

def _train(spark, d):
    return sp.split_part(V(spark, d, "ratings_v"), "train")


def _validation(spark, d):
    return sp.split_part(V(spark, d, "ratings_v"), "validation")


def _test(spark, d):
    return sp.split_part(V(spark, d, "ratings_v"), "test")


def _training(spark, d):
    return sp.training_union(_train(spark, d), V(spark, d, "my_ratings_v"))


def _own_seen(spark, d):
    return sp.positive_ratings(V(spark, d, "my_ratings_v")).select("userid", "movieid")


def _seen(spark, d):
    """Rated pairs of all users: the sample's ratings and the users' own."""
    return sp.positive_ratings(V(spark, d, "ratings_v")).select("userid", "movieid").unionByName(_own_seen(spark, d))


def _popularity(spark, d):
    return mdl.popularity_scores(V(spark, d, "movieinfo_v"), _training(spark, d))


SQL_SPLITS = [
    ("train", "SELECT userid, movieid, rating, ts FROM ratings_v WHERE ts % 10 < 6"),
    ("validation", "SELECT userid, movieid, rating, ts FROM ratings_v WHERE ts % 10 >= 6 AND ts % 10 < 8"),
    ("test", "SELECT userid, movieid, rating, ts FROM ratings_v WHERE ts % 10 >= 8"),
]
SQL_TRAINING = SQL_SPLITS + [
    ("training", "SELECT userid, movieid, rating FROM train UNION ALL "
                 "SELECT userid, movieid, CAST(rating AS DOUBLE) AS rating FROM my_ratings_v WHERE rating > 0"),
]
SQL_POPULARITY = SQL_TRAINING + [
    ("item_means", "SELECT movieid, avg(rating) AS item_mean FROM training GROUP BY movieid"),
    ("scores", "SELECT c.movieid, c.moviename, coalesce(m.item_mean, (SELECT avg(rating) FROM training)) AS prediction "
               "FROM movieinfo_v c LEFT JOIN item_means m ON c.movieid = m.movieid"),
    ("seen", "SELECT DISTINCT userid, movieid FROM (SELECT userid, movieid, rating FROM ratings_v UNION ALL "
             "SELECT userid, movieid, rating FROM my_ratings_v) r WHERE rating > 0"),
]
POP_VIEWS = ["ratings_v", "my_ratings_v", "movieinfo_v"]


# ------------------------------------------------------- slice 1: flagship --

@register(
    "topn_per_user",
    fx.oracle_with(POP_VIEWS, """
SELECT userid, movieid, moviename, prediction, CAST(rec_rank AS INTEGER) AS rec_rank FROM (
  SELECT u.userid, s.movieid, s.moviename, s.prediction,
         row_number() OVER (PARTITION BY u.userid ORDER BY s.prediction DESC, s.movieid) AS rec_rank
  FROM (SELECT DISTINCT userid FROM seen) u CROSS JOIN scores s
  WHERE s.prediction > 0 AND NOT isnan(s.prediction)
    AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.userid = u.userid AND x.movieid = s.movieid)) t
WHERE rec_rank <= 10""", SQL_POPULARITY),
)
def q_topn_per_user(spark, d):
    """W1 (+ C6, B5, E1, C7 for every user): ten best unseen catalog movies per
    user under the popularity predictor, with titles."""
    out = rec.top_unseen_per_user(None, _seen(spark, d), _popularity(spark, d), n=10)
    return out.select("userid", "movieid", "moviename", "prediction", F.col("rank").cast("int").alias("rec_rank"))


@register(
    "popularity_predictor",
    fx.oracle_with(POP_VIEWS, "SELECT movieid, moviename, prediction FROM scores", SQL_POPULARITY),
)
def q_popularity_predictor(spark, d):
    """M8: item mean over the training union, global mean for unrated items."""
    return _popularity(spark, d)


@register(
    "top10_recommendations",
    fx.oracle_with(POP_VIEWS, """
SELECT movieid, moviename, prediction FROM scores WHERE prediction > 0 AND NOT isnan(prediction)
ORDER BY prediction DESC, movieid LIMIT 10""", SQL_POPULARITY),
)
def q_top10(spark, d):
    """The ten best positive predictions overall (a distributed top-k)."""
    return rec.top_n_overall(_popularity(spark, d), 10)


@register(
    "unseen_candidates",
    fx.oracle_with(POP_VIEWS, """
SELECT u.userid, CAST(count(c.movieid) AS BIGINT) AS n_rated_in_catalog,
       CAST((SELECT count(*) FROM movieinfo_v) - count(c.movieid) AS BIGINT) AS n_candidates
FROM (SELECT DISTINCT userid FROM seen) u
LEFT JOIN seen s ON s.userid = u.userid
LEFT JOIN movieinfo_v c ON c.movieid = s.movieid
GROUP BY u.userid""", SQL_POPULARITY),
)
def q_unseen_candidates(spark, d):
    """Size of catalog minus rated movies per user (the set itself is never
    materialised; see recommend.top_unseen_per_user)."""
    seen = _seen(spark, d)
    return rec.unseen_candidate_counts(seen.select("userid"), seen, V(spark, d, "movieinfo_v"))



def _most_active_user(spark, d) -> int:
    """The user with the most personal ratings (ties: smallest id), from the data."""
    personal = V(spark, d, "my_ratings_v")
    return personal.groupBy("userid").count().orderBy(F.desc("count"), "userid").first()["userid"]


@register("user_movie_cross", fx.oracle_with(["ratings_v", "my_ratings_v", "movieinfo_v"], """
SELECT (SELECT userid FROM my_ratings_v GROUP BY userid ORDER BY count(*) DESC, userid LIMIT 1) AS userid, movieid
FROM movieinfo_v"""))
def q_user_movie_cross(spark, d):
    """C11: the single-user candidate pairs (user, every catalog movie) of the
    original job, for the most active user."""
    return rec.user_catalog_pairs(V(spark, d, "movieinfo_v"), _most_active_user(spark, d))

# ------------------------------------------------- slice 2: split & stats --

@register("time_mod_split", fx.oracle_with(["ratings_v"], """
SELECT userid, movieid, rating, ts,
       CASE WHEN ts % 10 < 6 THEN 'train' WHEN ts % 10 < 8 THEN 'validation' ELSE 'test' END AS split
FROM ratings_v"""))
def q_time_mod_split(spark, d):
    """Label each rating train / validation / test by ``ts % 10``."""
    return sp.time_mod_split(V(spark, d, "ratings_v"))


@register("positive_ratings", fx.oracle_with(["ratings_v", "my_ratings_v"],
                                             "SELECT * FROM my_ratings_v WHERE rating > 0"))
def q_positive_ratings(spark, d):
    """B2: the user's own positive ratings (fails when there are none)."""
    return sp.positive_ratings(V(spark, d, "my_ratings_v"), require_nonempty=True)


@register("dataset_stats", fx.oracle_with(["ratings_v"], """
SELECT CAST(count(*) AS BIGINT) AS num_ratings, CAST(count(DISTINCT userid) AS BIGINT) AS num_users,
       CAST(count(DISTINCT movieid) AS BIGINT) AS num_movies FROM ratings_v"""))
def q_dataset_stats(spark, d):
    """#ratings, #users, #movies."""
    return sp.dataset_stats(V(spark, d, "ratings_v"))


@register("split_counts", fx.oracle_with(["ratings_v"], """
SELECT l.split, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows,
       (l.split = 'train' AND coalesce(c.n, 0) = 0) OR (l.split = 'validation' AND coalesce(c.n, 0) < 10) AS flagged
FROM (VALUES ('train'), ('validation'), ('test')) l(split)
LEFT JOIN (SELECT CASE WHEN ts % 10 < 6 THEN 'train' WHEN ts % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
                  count(*) AS n FROM ratings_v GROUP BY 1) c ON c.split = l.split"""))
def q_split_counts(spark, d):
    """Rows per split, zero-filled, with the empty-train / small-validation flags."""
    return sp.split_counts(sp.time_mod_split(V(spark, d, "ratings_v")))


def _day_table(spark, d):
    """The day table of the sample: all days but the newest first, that one added alone."""
    ratings = stored(V(spark, d, "ratings_v").select("userid", "movieid", "ts"), "ratings")  # read four times
    newest = ratings.agg(F.max(dc.day_of())).scalar()
    path = scratch_path(spark, "day-bitmaps")
    dc.create(ratings.where(dc.day_of() < newest), path)
    dc.put_days(spark, path, ratings.where(dc.day_of() == newest))
    return path


@register("dataset_stats_by_day", fx.oracle_with(["ratings_v"], """
SELECT CAST(count(*) AS BIGINT) AS num_ratings, CAST(count(DISTINCT userid) AS BIGINT) AS num_users,
       CAST(count(DISTINCT movieid) AS BIGINT) AS num_movies FROM ratings_v"""))
def q_dataset_stats_by_day(spark, d):
    """D1 from mergeable bitmaps per day; the newest day was added without reading the others."""
    return dc.dataset_stats(spark, _day_table(spark, d))


@register("split_counts_by_day", fx.oracle_with(["ratings_v"], """
SELECT l.split, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows,
       (l.split = 'train' AND coalesce(c.n, 0) = 0) OR (l.split = 'validation' AND coalesce(c.n, 0) < 10) AS flagged
FROM (VALUES ('train'), ('validation'), ('test')) l(split)
LEFT JOIN (SELECT CASE WHEN ts % 10 < 6 THEN 'train' WHEN ts % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
                  count(*) AS n FROM ratings_v GROUP BY 1) c ON c.split = l.split"""))
def q_split_counts_by_day(spark, d):
    """D2 from the stored counts per day."""
    return dc.split_counts(spark, _day_table(spark, d))


@register("training_union", fx.oracle_with(["ratings_v", "my_ratings_v"], "SELECT * FROM training", SQL_TRAINING))
def q_training_union(spark, d):
    """sample training rows plus the users' own positive ratings."""
    return _training(spark, d)


@register("train_validation_union", fx.oracle_with(["ratings_v"], """
SELECT userid, movieid, rating FROM train UNION ALL SELECT userid, movieid, rating FROM validation""", SQL_SPLITS))
def q_train_validation_union(spark, d):
    """train plus validation (bag union)."""
    return sp.train_validation_union(_train(spark, d), _validation(spark, d))


@register("mean_rating", fx.oracle_with(["ratings_v"], """
SELECT avg(rating) AS mean_rating FROM (SELECT rating FROM train UNION ALL SELECT rating FROM validation) t""",
                                        SQL_SPLITS))
def q_mean_rating(spark, d):
    """D3: mean rating over train and validation."""
    return ev.mean_rating(sp.train_validation_union(_train(spark, d), _validation(spark, d)))


_MEAN_SQL = SQL_SPLITS + [("mean", "SELECT avg(rating) AS m FROM (SELECT rating FROM train UNION ALL "
                                   "SELECT rating FROM validation) t")]


@register("baseline_rmse", fx.oracle_with(["ratings_v"], """
SELECT round(sqrt(avg(pow(rating - (SELECT m FROM mean), 2))), 9) AS baseline_rmse FROM test""", _MEAN_SQL))
def q_baseline_rmse(spark, d):
    """RMSE of the global mean on the test split."""
    mean = ev.mean_rating(sp.train_validation_union(_train(spark, d), _validation(spark, d)))
    return ev.baseline_rmse(_test(spark, d), mean).select(F.round("baseline_rmse", 9).alias("baseline_rmse"))


_PRED_SQL = SQL_TRAINING + [
    ("item_means", "SELECT movieid, avg(rating) AS item_mean FROM training GROUP BY movieid"),
    ("val_pred", "SELECT v.userid, v.movieid, v.rating, coalesce(m.item_mean, 'NaN'::DOUBLE) AS prediction "
                 "FROM validation v LEFT JOIN item_means m ON v.movieid = m.movieid"),
]


def _val_predictions(spark, d):
    return mdl.popularity_predict(_validation(spark, d).select("userid", "movieid", "rating"), _training(spark, d))


@register("finite_predictions", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT v.userid, v.movieid, v.rating, m.item_mean AS prediction FROM validation v
JOIN (SELECT movieid, avg(CAST(rating AS DOUBLE)) AS item_mean FROM my_ratings_v WHERE rating > 0 GROUP BY movieid) m
  ON v.movieid = m.movieid""", SQL_SPLITS))
def q_finite_predictions(spark, d):
    """Validation pairs scored with the item means of the users' own ratings alone; the movies
    nobody rated there are NaN and go."""
    own = sp.positive_ratings(V(spark, d, "my_ratings_v"))
    pred = mdl.popularity_predict(_validation(spark, d).select("userid", "movieid", "rating"), own)
    return ev.finite_predictions(pred).select("userid", "movieid", "rating", "prediction")


@register("rmse", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT round(coalesce(sqrt(avg(pow(prediction - rating, 2))), 1.7976931348623157e308), 9) AS rmse,
       CAST(count(*) AS BIGINT) AS n_pairs
FROM val_pred WHERE NOT isnan(prediction)""", _PRED_SQL))
def q_rmse(spark, d):
    """Validation RMSE of the popularity predictor over finite predictions."""
    return ev.rmse(_val_predictions(spark, d)).select(F.round("rmse", 9).alias("rmse"), "n_pairs")


@register("rmse_pair_join", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT round(coalesce(sqrt(avg(pow(p.prediction - a.rating, 2))), 1.7976931348623157e308), 9) AS rmse,
       CAST(count(*) AS BIGINT) AS n_pairs
FROM val_pred p JOIN validation a ON p.userid = a.userid AND p.movieid = a.movieid
WHERE NOT isnan(p.prediction)""", _PRED_SQL))
def q_rmse_pair_join(spark, d):
    """The original (user, item) pair join before the RMSE: duplicates fan out."""
    preds = _val_predictions(spark, d)
    out = ev.rmse_pair_join(preds, _validation(spark, d))
    return out.select(F.round("rmse", 9).alias("rmse"), "n_pairs")


@register("improvement_pct", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT round(b.baseline_rmse, 9) AS baseline_rmse, round(t.test_rmse, 9) AS test_rmse,
       round((b.baseline_rmse - t.test_rmse) / b.baseline_rmse * 100, 6) AS improvement_pct
FROM (SELECT sqrt(avg(pow(rating - (SELECT m FROM mean), 2))) AS baseline_rmse FROM test) b,
     (SELECT sqrt(avg(pow(coalesce(m.item_mean, 'NaN'::DOUBLE) - t.rating, 2))) AS test_rmse
      FROM test t LEFT JOIN item_means m ON t.movieid = m.movieid WHERE m.item_mean IS NOT NULL) t""",
                                          _PRED_SQL + _MEAN_SQL[-1:]))
def q_improvement_pct(spark, d):
    """Improvement of the model's test RMSE over the mean baseline, in percent."""
    mean = ev.mean_rating(sp.train_validation_union(_train(spark, d), _validation(spark, d)))
    base = ev.baseline_rmse(_test(spark, d), mean)
    test_pred = mdl.popularity_predict(_test(spark, d).select("userid", "movieid", "rating"), _training(spark, d))
    test_rmse = ev.rmse(test_pred).select("rmse").scalar()  # scalar subquery
    both = base.withColumn("test_rmse", test_rmse)
    return both.select(
        F.round("baseline_rmse", 9).alias("baseline_rmse"),
        F.round("test_rmse", 9).alias("test_rmse"),
        F.round(ev.improvement_pct("baseline_rmse", "test_rmse"), 6).alias("improvement_pct"),
    )


@register("positive_predictions", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT userid, movieid, rating, prediction - (SELECT avg(rating) FROM training) AS prediction FROM val_pred
WHERE prediction - (SELECT avg(rating) FROM training) > 0
  AND NOT isnan(prediction - (SELECT avg(rating) FROM training))""", _PRED_SQL))
def q_positive_predictions(spark, d):
    """Keep ``prediction > 0`` with NaN excluded; the predictor here is the
    item-bias (item mean minus global mean), which is negative for weak items."""
    training = _training(spark, d)
    gm = training.select(F.avg("rating")).scalar()
    biased = _val_predictions(spark, d).withColumn("prediction", F.col("prediction") - gm)
    return biased.where(is_positive_prediction("prediction")).select("userid", "movieid", "rating", "prediction")


# Further registrations live in sibling modules; importing them fills the registry.
from . import queries_web  # noqa: E402,F401
from . import queries_io  # noqa: E402,F401
from . import queries_model  # noqa: E402,F401
from . import queries_stream  # noqa: E402,F401
