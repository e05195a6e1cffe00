"""Registered queries of the sources and sinks: each writes data derived from
the given tables through the sink and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import recommend as rec
from .plans.joins import join_dimension
from .queries import POP_VIEWS, SQL_POPULARITY, V, _popularity, _seen, register
from .queries_web import SQL_FAILED_USERS, failed_users
from .session import scratch_path
from .sources import tables as tb
from .sources import text as tx

GENRES_SQL = ("CASE WHEN typelist IS NULL OR typelist = '' THEN '' ELSE "
              "array_to_string(list_transform(string_split(typelist, ','), lambda g: trim(g)), '|') END")


@register("scan_ratings", fx.oracle_with(["ratings_v"], """
SELECT userid AS "user", movieid AS product, rating, ts FROM ratings_v"""))
def q_scan_ratings(spark, d):
    """A1: ratings written as ``u::m::r::ts`` text and read back typed."""
    path = scratch_path(spark, "ratings-dat")
    tx.write_lines(tx.encode_records(V(spark, d, "ratings_v"), ["userid", "movieid", "rating", "ts"], "value"), path)
    return tx.read_ratings(spark, path)


@register("export_movies_dat", fx.oracle_with(["movieinfo_v"], f"""
SELECT CAST(movieid AS VARCHAR) || '::' || moviename || '::' || {GENRES_SQL} AS line FROM movieinfo_v"""))
def q_export_movies_dat(spark, d):
    """A10: the catalog exported as ``movies.dat`` lines."""
    path = scratch_path(spark, "movies-dat")
    tx.write_lines(tx.movies_dat_lines(V(spark, d, "movieinfo_v")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("scan_movies", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid, moviename, nullif({GENRES_SQL}, '') AS genres FROM movieinfo_v"""))
def q_scan_movies(spark, d):
    """A2: ``movies.dat`` read back (missing genres are NULL)."""
    path = scratch_path(spark, "movies-dat")
    tx.write_lines(tx.movies_dat_lines(V(spark, d, "movieinfo_v")), path)
    return tx.read_movies(spark, path)


SQL_RECS_TITLES = """
SELECT r.userid, r.movieid, r.degree, m.moviename FROM recommendations_v r JOIN movieinfo_v m ON r.movieid = m.movieid"""


def _recs_with_titles(spark, d):
    return join_dimension(V(spark, d, "recommendations_v"), V(spark, d, "movieinfo_v").select("movieid", "moviename"),
                          "movieid")


@register("encode_records", fx.oracle_with(["ratings_v", "recommendations_v", "movieinfo_v"], f"""
SELECT CAST(userid AS VARCHAR) || '::' || CAST(movieid AS VARCHAR) || '::' || CAST(degree AS VARCHAR) || '::'
       || coalesce(moviename, '') AS record FROM ({SQL_RECS_TITLES}) t"""))
def q_encode_records(spark, d):
    """Result rows as ``user::movie::score::title`` records."""
    return tx.encode_records(_recs_with_titles(spark, d), ["userid", "movieid", "degree", "moviename"])


@register("decode_records", fx.oracle_with(["ratings_v", "recommendations_v", "movieinfo_v"], f"""
SELECT userid, movieid, CAST(degree AS DOUBLE) AS rating, moviename FROM ({SQL_RECS_TITLES}) t"""))
def q_decode_records(spark, d):
    """Records parsed back into typed columns."""
    enc = tx.encode_records(_recs_with_titles(spark, d), ["userid", "movieid", "degree", "moviename"])
    return tx.decode_records(enc, [("userid", "int"), ("movieid", "int"), ("rating", "double"),
                                   ("moviename", "string")])


SQL_NEWRECS = SQL_POPULARITY + [("newrecs", """
SELECT userid, movieid, CAST(prediction AS FLOAT) AS degree FROM (
  SELECT u.userid, s.movieid, s.prediction,
         row_number() OVER (PARTITION BY u.userid ORDER BY s.prediction DESC, s.movieid) AS rn
  FROM (SELECT DISTINCT userid FROM progress_v) u CROSS JOIN scores s
  WHERE s.prediction > 0 AND NOT isnan(s.prediction)
    AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.userid = u.userid AND x.movieid = s.movieid)) t
WHERE rn <= 10""")]
NEWREC_VIEWS = POP_VIEWS + ["progress_v", "recommendations_v"]


def _new_recs(spark, d):
    """Fresh popularity recommendations for every user that ran a job."""
    users = V(spark, d, "progress_v").select("userid").distinct()
    out = rec.top_unseen_per_user(users, _seen(spark, d), _popularity(spark, d), n=10)
    return out.select("userid", "movieid", F.col("prediction").cast("float").alias("degree"))


@register("sink_recommendations_append", fx.oracle_with(NEWREC_VIEWS, """
SELECT userid, movieid, degree FROM recommendations_v UNION ALL SELECT userid, movieid, degree FROM newrecs""",
                                                       SQL_NEWRECS))
def q_sink_append(spark, d):
    """A4: new result rows appended to the stored recommendation table."""
    path = scratch_path(spark, "recs-table")
    tb.create_keyed_table(V(spark, d, "recommendations_v"), path, "userid")
    tb.append_rows(_new_recs(spark, d), path, "userid")
    return tb.read_keyed_table(spark, path)


@register("sink_recommendations_replace", fx.oracle_with(NEWREC_VIEWS, """
SELECT userid, movieid, degree FROM recommendations_v WHERE userid NOT IN (SELECT userid FROM newrecs)
UNION ALL SELECT userid, movieid, degree FROM newrecs""", SQL_NEWRECS))
def q_sink_replace(spark, d):
    """A5: a user's stored recommendations replaced by the new ones (delete +
    insert), only the touched key buckets rewritten."""
    path = scratch_path(spark, "recs-table")
    tb.create_keyed_table(V(spark, d, "recommendations_v"), path, "userid")
    tb.replace_by_key(spark, path, _new_recs(spark, d), "userid")
    return tb.read_keyed_table(spark, path)


@register("delete_by_user", fx.oracle_with(["ratings_v", "recommendations_v", "progress_v"], """
SELECT * FROM recommendations_v r WHERE NOT EXISTS (SELECT 1 FROM progress_v p WHERE p.userid = r.userid)"""))
def q_delete_by_user(spark, d):
    """Stored results of the users that start a job are deleted."""
    return tb.delete_by_key(V(spark, d, "recommendations_v"), V(spark, d, "progress_v"), "userid")


@register("temp_view_sql", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT userid, movieid, rating FROM my_ratings_v WHERE rating >= 4"""))
def q_temp_view_sql(spark, d):
    """A temp view queried with bound SQL parameters."""
    return tb.query_view(spark, V(spark, d, "my_ratings_v"), "personalratings",
                         "SELECT userid, movieid, rating FROM personalratings WHERE rating >= :min_rating",
                         {"min_rating": 4})


@register("title_lookup", fx.oracle_with(["ratings_v", "recommendations_v", "movieinfo_v"], """
SELECT r.userid, r.movieid, m.moviename FROM recommendations_v r JOIN movieinfo_v m ON r.movieid = m.movieid"""))
def q_title_lookup(spark, d):
    """Result ids mapped to titles read from ``movies.dat``."""
    path = scratch_path(spark, "movies-dat")
    tx.write_lines(tx.movies_dat_lines(V(spark, d, "movieinfo_v")), path)
    titles = tx.read_movies(spark, path).select("movieid", "moviename")
    return rec.with_titles(V(spark, d, "recommendations_v").select("userid", "movieid"), titles)



@register("scan_personal_ratings", fx.oracle_with(["my_ratings_v", "progress_v"], f"""
SELECT userid, movieid, rating, timestamp FROM my_ratings_v WHERE userid IN ({SQL_FAILED_USERS})"""))
def q_scan_personal_ratings(spark, d):
    """A3: the personal-ratings table read for a set of users (those whose last
    job failed) with the user filter pushed to storage: stored as a keyed table, read
    back bucket-pruned.  (Over JDBC the same read is ``sources.jdbc.read_jdbc``
    plus a ``where``, which Spark pushes into the database query.)"""
    path = scratch_path(spark, "personalratings")
    tb.create_keyed_table(V(spark, d, "my_ratings_v"), path, "userid")
    return tb.read_rows_for_keys(spark, path, failed_users(spark, d), "userid")
