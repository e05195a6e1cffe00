"""Exact distinct counts that merge: bitmaps per day, or-ed on read.

For every day a table holds the number of ratings per split and, for users and movies, one
bitmap per 32,768 neighbouring ids (``bitmap_construct_agg``).  Statistics over any days
are sums and ``bitmap_or_agg``; adding or replacing a day reads that day's ratings alone.  Equal to
``countDistinct`` for any whole-number ids.  A bitmap is 4 kB however few ids it
holds, so a day's rows are at most its distinct ids and usually ids / 32,768.

A null id counts in the rows but in no distinct count, as in ``countDistinct``; a null time
is the null day.  The table is a keyed table of ``sources.tables`` with the day as its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources import tables as tb
from .split import split_label

SECONDS = 86_400


def day_of(ts_col: str = "ts"):
    return F.floor(F.col(ts_col) / SECONDS).cast("long")


def day_bitmaps(ratings: DataFrame, user_col: str = "userid", item_col: str = "movieid", ts_col: str = "ts") -> DataFrame:
    """day, kind (user, movie or a split), bucket, bitmap, n: counts have no bitmap."""
    rows = ratings.select(day_of(ts_col).alias("day"), F.col(user_col).cast("long").alias("user"),
                          F.col(item_col).cast("long").alias("movie"), split_label(ts_col).alias("split"))
    ids = rows.select("day", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("user", "movie")])).alias("x")).select("day", "x.*")
    places = ids.where("id IS NOT NULL").select(
        "day", "kind", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit")).distinct()
    # the places of a bitmap, 32,768 at most, are brought together before it is made: bitmaps of
    # part of the rows would each be sorted and sent at 4 kB for the few ids they hold
    bits = places.repartition("day", "kind", "bucket").groupBy("day", "kind", "bucket").agg(
        F.bitmap_construct_agg("bit").alias("bitmap"))
    counts = rows.groupBy("day", F.col("split").alias("kind")).agg(F.count("*").alias("n"))
    return bits.select("day", "kind", "bucket", "bitmap", F.lit(0).cast("long").alias("n")).unionByName(
        counts.select("day", "kind", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bitmap"), "n"))


def create(ratings: DataFrame, path: str, buckets: int | None = None) -> None:
    tb.create_keyed_table(stored(day_bitmaps(ratings), "day-rows"), path, "day", buckets)  # counted, then written


def put_days(spark: SparkSession, path: str, ratings: DataFrame) -> None:
    """The days of ``ratings`` become exactly these rows; other days are not read."""
    tb.replace_by_key(spark, path, day_bitmaps(ratings), "day")


def _days(spark: SparkSession, path: str, first: int | None, last: int | None) -> DataFrame:
    rows = tb.read_keyed_table(spark, path)
    if first is not None:
        rows = rows.where(F.col("day") >= first)
    return rows if last is None else rows.where(F.col("day") <= last)


def dataset_stats(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """D1 over all days, or over ``first`` to ``last``."""
    rows = _days(spark, path, first, last)
    merged = rows.groupBy("kind", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("n").alias("n"))

    def distinct(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bitmap"))), F.lit(0)).cast("long")

    return merged.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("num_ratings"),
                      distinct("user").alias("num_users"), distinct("movie").alias("num_movies"))


def split_counts(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """D2 from the stored counts."""
    from .split import count_flags

    return count_flags(_days(spark, path, first, last), "kind", "n")
