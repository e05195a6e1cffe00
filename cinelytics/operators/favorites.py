"""Favourites: listing, category filter, counts, existence checks, add/remove
with the unique (user, movie, category) rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import is_in_dimension, join_dimension
from ..plans.ranking import row_number_within

KEY = ["userid", "movieid", "category"]


def valid_categories(requests: DataFrame, category_col: str = "category") -> DataFrame:
    """Apply the default (``liked``) and flag whitelisted categories."""
    return requests.withColumn("category_used", C.valid_category(category_col)).withColumn(
        "is_valid", C.is_valid_category(category_col)
    )


def favorites_by_category(favorites: DataFrame, category: str | None) -> DataFrame:
    """Optional filter; a value outside the whitelist means no filter."""
    if category and category in C.VALID_CATEGORIES:
        return favorites.where(F.col("category") == category)
    return favorites


def favorites_list(favorites: DataFrame, catalog: DataFrame, join=join_dimension) -> DataFrame:
    """Favourites left-joined to the catalog; ``join`` as in ``ratings.rating_history``."""
    cat = catalog.select("movieid", "moviename", "picture", "averating", "typelist", "releasetime", "director")
    return join(favorites, cat, "movieid", "left")


def favorites_sorted(favorites: DataFrame) -> DataFrame:
    """Number each user's favourites newest first (ties: higher id first)."""
    return row_number_within(favorites, ["userid"], [F.col("createtime").desc(), F.col("id").desc()], "list_rank")


def favorites_display(listed: DataFrame) -> DataFrame:
    return listed.select(
        "userid", F.col("movieid").alias("id"),
        C.or_default("moviename", C.UNKNOWN_MOVIE).alias("title"),
        C.poster("picture").alias("poster"),
        C.to_fixed_1("averating").alias("rating"),
        C.genre_text("typelist", 3).alias("genres"),
        C.release_year("releasetime").alias("release_year"),
        C.or_default("director", C.UNKNOWN).alias("director"),
        C.epoch_micros("createtime").alias("added_us"),
    )


def favorites_count(favorites: DataFrame) -> DataFrame:
    """Per user: count per known category (zero filled) and the total over every
    category, in one pass."""
    per = [F.count_if(F.col("category") == c).alias(c) for c in C.VALID_CATEGORIES]
    return favorites.groupBy("userid").agg(*per, F.count(F.lit(1)).alias("total"))


def favorite_categories(favorites: DataFrame) -> DataFrame:
    """Per (user, movie): the sorted list of its categories (at most three)."""
    return favorites.groupBy("userid", "movieid").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def favorite_check(pairs: DataFrame, favorites: DataFrame) -> DataFrame:
    """Is each (user, movie) pair a favourite in any category."""
    return is_in_dimension(pairs, favorites, ["userid", "movieid"], "favorited")


def favorites_add(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert requests whose (user, movie, category) is absent; the first request
    of a key wins.  Returns ``(table_after, report)``; the report flags every
    request with ``already_exists`` (key present before, or an earlier request)."""
    req = valid_categories(requests).where("is_valid").withColumn("category", F.col("category_used")).drop(
        "category_used", "is_valid")
    first = req.groupBy(*KEY).agg(F.min(F.struct("createtime", "id")).alias("f")).select(*KEY, "f.id", "f.createtime")
    fresh = first.join(existing.select(*KEY), KEY, "left_anti")
    table_after = existing.select("id", *KEY, "createtime").unionByName(fresh.select("id", *KEY, "createtime"))
    inserted = fresh.select(*KEY, F.col("id").alias("__first_id"))
    report = req.join(inserted, KEY, "left").select(
        "id", *KEY, (F.col("__first_id").isNull() | (F.col("__first_id") != F.col("id"))).alias("already_exists")
    )
    return table_after, report


def favorites_remove(favorites: DataFrame, removals: DataFrame, by_category: bool = False) -> DataFrame:
    """Delete by (user, movie), or by (user, movie, category) when asked to."""
    keys = KEY if by_category else ["userid", "movieid"]
    return favorites.join(removals.select(*keys).distinct(), keys, "left_anti").select(*favorites.columns)
