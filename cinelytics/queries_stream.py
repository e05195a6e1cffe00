"""Registered streaming queries; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as fx
from .functions import columns as C
from .queries import V, register
from .queries_web import SQL_LATEST_PROGRESS, SQL_REPLACED
from .session import prepare, scratch_path
from .sources import tables as tb
from .streaming import incremental as inc
from .streaming import state

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1,
                 glob: str = "events*.parquet") -> DataFrame:
    """The ``events`` table of a folder as a file stream (directory source with
    a name filter; a single-file path is not a valid stream source)."""
    prepare(spark)
    return (spark.readStream.schema(EVENTS_SCHEMA)
            .option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(sf_dir))


@register("stream_progress_latest", fx.oracle_with(["progress_v"], f"""
SELECT userid, event_id, epoch_us(ts) AS ts_us, progress, step FROM ({SQL_LATEST_PROGRESS}) l"""))
def q_stream_progress_latest(spark, d):
    """Latest progress per user, maintained by a streaming aggregation."""
    latest = state.stream_progress_latest(fx.progress_rows(event_stream(spark, d)))
    return latest.select("userid", "event_id", C.epoch_micros("ts").alias("ts_us"), "progress", "step")


@register("stream_replace_ratings", fx.oracle_with(["ratings_v", "my_ratings_v", "submissions_v"], SQL_REPLACED))
def q_stream_replace_ratings(spark, d):
    """The newest streamed submission of each user replaces their rows of the ratings table."""
    path = scratch_path(spark, "stream-ratings")
    tb.create_keyed_table(V(spark, d, "my_ratings_v"), path, "userid")
    state.stream_replace_ratings(fx.submission_rows(event_stream(spark, d)), path)
    return tb.read_keyed_table(spark, path)


@register("stream_favorites_dedup", fx.oracle_with(["favorites_v"], """
SELECT id, userid, movieid, category, epoch_us(createtime) AS createtime_us FROM favorites_v"""))
def q_stream_favorites_dedup(spark, d):
    """Favourites with the first insert of each key winning, from the stream."""
    fav = state.stream_favorites_dedup(fx.favorite_rows(event_stream(spark, d)))
    return fav.select("id", "userid", "movieid", "category", C.epoch_micros("createtime").alias("createtime_us"))



@register("stream_rating_stats", fx.oracle_with(["ratings_v", "my_ratings_v", "submissions_v"], f"""
SELECT userid, CAST(count(*) AS BIGINT) AS total_ratings, avg(CAST(rating AS DOUBLE)) AS avg_rating,
       {", ".join(f"CAST(count(*) FILTER (WHERE rating = {k}) AS BIGINT) AS n_{k}" for k in range(1, 6))}
FROM ({SQL_REPLACED}) r GROUP BY userid"""))
def q_stream_rating_stats(spark, d):
    """D8 under S5: rating statistics maintained by signed deltas while the stream replaces ratings."""
    path, view = scratch_path(spark, "stream-ratings"), inc.rating_stats_view(scratch_path(spark, "stream-stats"))
    own = V(spark, d, "my_ratings_v")
    tb.create_keyed_table(own, path, "userid")
    view.create(own)
    state.stream_replace_ratings(fx.submission_rows(event_stream(spark, d)), path, views=[view])
    return inc.rating_stats(view, spark).drop("avg_text")


@register("stream_favorites_count", fx.oracle_with(["favorites_v"], """
SELECT userid, CAST(count(*) FILTER (WHERE category = 'want_watch') AS BIGINT) AS want_watch,
       CAST(count(*) FILTER (WHERE category = 'watched') AS BIGINT) AS watched,
       CAST(count(*) FILTER (WHERE category = 'liked') AS BIGINT) AS liked, CAST(count(*) AS BIGINT) AS total
FROM favorites_v GROUP BY userid"""))
def q_stream_favorites_count(spark, d):
    """D7 under S6: favourites per category maintained by signed deltas of the stream's state."""
    view = inc.favorites_count_view(scratch_path(spark, "stream-favorites-count"))
    state.stream_favorites_dedup(fx.favorite_rows(event_stream(spark, d)), views=[view])
    return inc.favorites_count(view, spark)


@register("stream_favorites_dedup_bounded", fx.oracle_with(["favorites_v"], """
SELECT userid, movieid, category FROM favorites_v"""))
def q_stream_favorites_dedup_bounded(spark, d):
    """S6 bounded variant: one row per (user, movie, category) with watermark-
    limited dedup state (parquet file sink, append mode)."""
    requests = fx.favorite_rows(event_stream(spark, d))
    return state.stream_favorites_dedup_bounded(requests, "31 days").select("userid", "movieid", "category")
