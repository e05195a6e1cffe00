"""Catalog operators: detail and card projections, id lists, search, paging,
reproducible random sample and its selection batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import join_dimension
from ..plans.ranking import global_rank

# --- Fixed values of the catalog page -----------------------------------------
SORT_FIELDS = ("movieid", "averating", "numrating", "releasetime")
DEFAULT_SORT = "movieid"
PRESETS = {  # the page's three buttons
    "highest_rated": ("averating", "desc"),
    "most_popular": ("numrating", "desc"),
    "newest": ("releasetime", "desc"),
}
# -----------------------------------------------------------------------------
SHALLOW_ROWS = 10_000  # pages up to here come from a top-k; its heap is kept per task


def movie_details(catalog: DataFrame) -> DataFrame:
    """Detail page projection with the page's defaults (all genres)."""
    return catalog.select(
        F.col("movieid").alias("id"),
        F.col("moviename").alias("title"),
        F.date_format("releasetime", "yyyy-MM-dd").alias("release_date"),
        C.release_year("releasetime").alias("release_year"),
        F.col("director"),
        F.col("leadactors").alias("actors"),
        "description",
        C.poster("picture").alias("poster"),
        C.to_fixed_1("averating").alias("rating"),
        C.votes("numrating").alias("votes"),
        C.genre_text("typelist").alias("genres"),
    )


def movie_by_id(catalog: DataFrame, ids) -> DataFrame:
    """Point lookup (an int) or lookup of many ids (a frame with ``movieid``)."""
    if isinstance(ids, DataFrame):
        return join_dimension(catalog, ids.select("movieid").distinct(), "movieid", "left_semi")
    return catalog.where(F.col("movieid") == F.lit(int(ids)))


def ids_from_list(df: DataFrame, list_col: str, out_col: str = "movieid") -> DataFrame:
    """``'1,2,,5'`` -> one row per non-blank id (the original filters blanks and
    binds the rest as parameters of ``IN (...)``)."""
    ids = F.transform(F.split(F.col(list_col), ","), lambda x: F.trim(x).try_cast("int"))
    # IN (...) matches a repeated id once
    return df.select("*", F.explode(F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))).alias(out_col))


def movies_in_list(requests: DataFrame, list_col: str, catalog: DataFrame, keep=("movieid", "moviename", "picture")) -> DataFrame:
    """For every request row, the catalog movies whose id is in its comma list."""
    exploded = ids_from_list(requests, list_col)
    return join_dimension(exploded, catalog.select(*keep), "movieid")


def title_search(catalog: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive substring match on the trimmed term; empty matches all.
    ``%`` and ``_`` are literal (no LIKE)."""
    t = (term or "").strip()
    if not t:
        return catalog
    return catalog.where(F.lower(F.col("moviename")).contains(t.lower()))


def catalog_display(catalog: DataFrame) -> DataFrame:
    """Card projection of the library page: first three genres."""
    return catalog.select(
        F.col("movieid").alias("id"),
        F.col("moviename").alias("title"),
        C.release_year("releasetime").alias("release_date"),
        "director",
        F.col("leadactors").alias("actors"),
        "description",
        C.poster("picture").alias("poster"),
        C.to_fixed_1("averating").alias("rating"),
        C.votes("numrating").alias("votes"),
        C.genre_text("typelist", 3).alias("genres"),
        F.col("typelist").alias("full_genres"),
    )


def sort_spec(sort: str | None, order: str | None):
    """Whitelisted sort field, DESC unless ``asc``; presets accepted by name."""
    if sort in PRESETS:
        sort, order = PRESETS[sort]
    field = sort if sort in SORT_FIELDS else DEFAULT_SORT
    ascending = order == "asc"
    primary = F.col(field).asc_nulls_first() if ascending else F.col(field).desc_nulls_last()
    # ties broken by id so that pages are stable
    return [primary, F.col("movieid").asc()]


def catalog_page(catalog: DataFrame, page: int | str | None = 1, sort: str | None = None,
                 order: str | None = None, page_size: int = C.PAGE_SIZE,
                 shallow_rows: int = SHALLOW_ROWS) -> DataFrame:
    """One page of the sorted catalog, with the page position in ``page_pos``.
    The first ``SHALLOW_ROWS`` rows are a distributed top-k with offset; a deeper
    page is cut from the global rank, so no task holds all the rows before it."""
    digits = re.match(r"\s*([+-]?\d+)", "" if page is None else str(page))  # parseInt(x) || 1
    p = int(digits[1]) if digits else 1
    p = p if p >= 1 else 1
    offset = (p - 1) * page_size
    spec = sort_spec(sort, order)
    if offset + page_size <= shallow_rows:
        rows = catalog.orderBy(*spec).offset(offset).limit(page_size)
    else:
        rows = global_rank(catalog, spec, "__pos").where(
            F.col("__pos").between(offset + 1, offset + page_size)).drop("__pos")
    w = Window.orderBy(*spec)  # at most page_size rows
    return rows.withColumn("page_pos", F.row_number().over(w))


def catalog_page_count(catalog: DataFrame, page_size: int = C.PAGE_SIZE) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("total_movies")).select(
        "total_movies", F.ceil(F.col("total_movies") / page_size).cast("long").alias("total_pages")
    )


def random_movie_sample(catalog: DataFrame, n: int = C.SAMPLE_SIZE, seed: str | int = 0) -> DataFrame:
    """``ORDER BY RAND() LIMIT n`` made reproducible: order by md5(seed:id)."""
    key = C.stable_sample_key(seed, "movieid")
    return catalog.withColumn("sample_key", key).orderBy("sample_key").limit(n)


def movie_batches(sample: DataFrame, batch_size: int = C.BATCH_SIZE, order_col: str = "sample_key") -> DataFrame:
    """Batch index of each movie of the (bounded, <= 200 rows) sample."""
    w = Window.orderBy(order_col)
    return sample.withColumn("batch_index", F.floor((F.row_number().over(w) - 1) / batch_size).cast("int"))
