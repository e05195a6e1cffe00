"""Registered queries of the web half: catalog, history, submissions,
favourites, job status.  Each runs for all users at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import columns as C
from .operators import catalog as cat
from .operators import favorites as fav
from .operators import ratings as rt
from .operators import search
from .operators import recommend as rec
from .operators import status as st
from .plans.joins import join_dimension, join_in_place
from .queries import V, register
from .session import scratch_path
from .sources import colocated, ranked

# ------------------------------------------------- DuckDB text of helpers --
NO_POSTER = C.NO_POSTER


def S_FIXED(x):
    return f"CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) THEN '0.0' ELSE printf('%.1f', {x}) END"


def S_POSTER(x):
    return f"coalesce(nullif({x}, ''), '{NO_POSTER}')"


def S_DEFAULT(x, d):
    return f"coalesce(nullif({x}, ''), '{d}')"


def S_YEAR(x):
    return f"coalesce(CAST(year({x}) AS VARCHAR), '{C.UNKNOWN}')"


def S_VOTES(x):
    return f"CAST(CASE WHEN {x} IS NULL OR {x} = 0 THEN 0 ELSE {x} END AS INTEGER)"


def S_GENRES(x, n=None):
    lst = f"list_transform(string_split({x}, ','), lambda g: trim(g))"
    if n is not None:
        lst = f"list_slice({lst}, 1, {n})"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE array_to_string({lst}, '|') END"


def S_PINT(x):
    return f"TRY_CAST(NULLIF(regexp_extract(ltrim(CAST({x} AS VARCHAR)), '^([+-]?[0-9]+)', 1), '') AS INTEGER)"


def S_US(x):
    return f"epoch_us({x})"


# ----------------------------------------------------------------- catalog --

@register("movie_by_id", fx.oracle_with(["movieinfo_v", "favorites_v"], f"""
SELECT movieid AS id, moviename AS title, strftime(releasetime, '%Y-%m-%d') AS release_date,
       {S_YEAR('releasetime')} AS release_year, director, leadactors AS actors, description,
       {S_POSTER('picture')} AS poster,
       {S_FIXED('averating')} AS rating, {S_VOTES('numrating')} AS votes, {S_GENRES('typelist')} AS genres
FROM movieinfo_v WHERE movieid IN (SELECT movieid FROM favorites_v)"""))
def q_movie_by_id(spark, d):
    """Detail projection of every movie somebody marked as a favourite."""
    return cat.movie_details(cat.movie_by_id(V(spark, d, "movieinfo_v"), V(spark, d, "favorites_v")))


@register("movies_in_list", fx.oracle_with(["movieinfo_v", "submissions_v"], """
SELECT s.submission_id, s.userid, c.movieid, c.moviename, c.picture
FROM (SELECT DISTINCT submission_id, userid, TRY_CAST(trim(item) AS INTEGER) AS item
      FROM (SELECT submission_id, userid, unnest(string_split(regexp_replace(pairs, ':[0-9]+', '', 'g'), ',')) AS item
            FROM submissions_v) i) s
JOIN movieinfo_v c ON c.movieid = s.item"""))
def q_movies_in_list(spark, d):
    """Movies of each submission's comma-separated id list."""
    subs = V(spark, d, "submissions_v").select(
        "submission_id", "userid", F.regexp_replace("pairs", r":\d+", "").alias("selected_ids"))
    out = cat.movies_in_list(subs, "selected_ids", V(spark, d, "movieinfo_v"))
    return out.select("submission_id", "userid", "movieid", "moviename", "picture")


SEARCH_TERM = "ring"


@register("title_search", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid, moviename FROM movieinfo_v WHERE contains(lower(moviename), '{SEARCH_TERM}')"""))
def q_title_search(spark, d):
    """Case-insensitive title search."""
    return cat.title_search(V(spark, d, "movieinfo_v"), f"  {SEARCH_TERM.upper()} ").select("movieid", "moviename")


@register("title_search_terms", fx.oracle_with(["movieinfo_v"], """
SELECT t.term, m.movieid FROM (SELECT DISTINCT lower(trim(substring(moviename, CAST(1 + movieid % 5 AS INT), CAST(movieid % 8 AS INT)))) AS term
  FROM movieinfo_v WHERE moviename IS NOT NULL) t JOIN movieinfo_v m ON contains(lower(m.moviename), t.term)"""))
def q_title_search_terms(spark, d):
    """B8 for a table of terms (pieces of the titles, none to seven characters): posting lists, no scan per term."""
    catalog = V(spark, d, "movieinfo_v")
    piece = F.substring("moviename", (1 + F.col("movieid") % 5).cast("int"), (F.col("movieid") % 8).cast("int"))
    return search.search_terms(catalog.select(piece.alias("term")), search.title_postings(catalog))


@register("catalog_display", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid AS id, moviename AS title, {S_YEAR('releasetime')} AS release_date, director,
       leadactors AS actors, description,
       {S_POSTER('picture')} AS poster, {S_FIXED('averating')} AS rating, {S_VOTES('numrating')} AS votes,
       {S_GENRES('typelist', 3)} AS genres, typelist AS full_genres
FROM movieinfo_v"""))
def q_catalog_display(spark, d):
    """Library cards with all display defaults."""
    return cat.catalog_display(V(spark, d, "movieinfo_v"))


@register("catalog_page", fx.oracle_with(["movieinfo_v"], """
SELECT movieid, moviename, strftime(releasetime, '%Y-%m-%d') AS releasetime, director, picture, averating,
       numrating, typelist, leadactors, description,
       CAST(row_number() OVER (ORDER BY averating DESC NULLS LAST, movieid) AS BIGINT) AS page_pos
FROM (SELECT * FROM movieinfo_v ORDER BY averating DESC NULLS LAST, movieid LIMIT 24 OFFSET 24) t"""))
def q_catalog_page(spark, d):
    """Page 2 of the catalog sorted by rating, descending."""
    page = cat.catalog_page(V(spark, d, "movieinfo_v"), page=2, sort="averating", order="desc")
    return page.withColumn("page_pos", F.col("page_pos").cast("long")).withColumn(
        "releasetime", F.date_format("releasetime", "yyyy-MM-dd"))


PAGE_MODES = {  # name: (sort, order, DuckDB ordering)
    "most_popular": ("most_popular", None, "numrating DESC NULLS LAST"),
    "newest": ("newest", None, "releasetime DESC NULLS LAST"),
    "worst_rated": ("averating", "asc", "averating ASC NULLS FIRST"),
    "default": (None, None, "movieid DESC"),
}


@register("catalog_page_modes", fx.oracle_with(["movieinfo_v"], "\nUNION ALL\n".join(f"""
SELECT '{mode}' AS sort_mode, movieid, CAST(pos - 24 AS BIGINT) AS page_pos FROM (
  SELECT movieid, row_number() OVER (ORDER BY {by}, movieid) AS pos FROM movieinfo_v) t
WHERE pos BETWEEN 25 AND 48""" for mode, (_, _, by) in PAGE_MODES.items())))
def q_catalog_page_modes(spark, d):
    """Page 2 under the other presets, ascending with NULLs first, and the default order."""
    pages = [cat.catalog_page(V(spark, d, "movieinfo_v"), 2, sort, order).select(
        F.lit(mode).alias("sort_mode"), "movieid", F.col("page_pos").cast("long").alias("page_pos"))
        for mode, (sort, order, _) in PAGE_MODES.items()]
    return reduce(DataFrame.unionByName, pages)


@register("catalog_pages_stored", fx.oracle_with(["movieinfo_v"], """
SELECT movieid, moviename, averating, CAST((pos - 1) // 24 + 1 AS BIGINT) AS page, pos AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY averating DESC NULLS LAST, movieid) AS pos,
         CAST(ceil(count(*) OVER () / 24) AS BIGINT) AS pages FROM movieinfo_v) t
WHERE (pos - 1) // 24 + 1 IN (1, pages // 2 + 1, pages)"""))
def q_catalog_pages_stored(spark, d):
    """First, middle and last page from the stored order; a page reads the files that hold it."""
    stored = _stored_order(spark, d, "movieinfo_v", "catalog", cat.sort_spec("highest_rated", None))
    last = -(-stored.total // C.PAGE_SIZE)
    pages = [stored.page(p, C.PAGE_SIZE).withColumn("page", F.lit(p).cast("long")) for p in sorted({1, last // 2 + 1, last})]
    return reduce(DataFrame.unionByName, pages).select("movieid", "moviename", "averating", "page", "rank")


# (application, input folder, name) -> stored tables
_STORED: dict[tuple[str, str, str], ranked.RankedTable | colocated.Colocated] = {}


def _stored_order(spark, d, view, name, order, groups=()):
    """The view in a stored order: written once per input and application."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _STORED:
        _STORED[at] = ranked.write_ranked(V(spark, d, view), scratch_path(spark, f"ranked-{name}"), order, groups)
    return _STORED[at]


def _colocated(spark, d, name, key, tables):
    """The tables that ``tables()`` builds in shared buckets of ``key``: written once per input and application."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _STORED:
        _STORED[at] = colocated.write_colocated(tables(), key, scratch_path(spark, f"colocated-{name}"))
    return _STORED[at]


def _by_movie(spark, d):
    return _colocated(spark, d, "by-movie", "movieid", lambda: {
        "ratings": V(spark, d, "my_ratings_v"), "favorites": V(spark, d, "favorites_v"), "movies": V(spark, d, "movieinfo_v")})


@register("catalog_page_count", fx.oracle_with(["movieinfo_v"], """
SELECT CAST(count(*) AS BIGINT) AS total_movies, CAST(ceil(count(*) / 24) AS BIGINT) AS total_pages
FROM movieinfo_v"""))
def q_catalog_page_count(spark, d):
    """Movie count and page count."""
    return cat.catalog_page_count(V(spark, d, "movieinfo_v"))


SAMPLE_SEED = 7
SQL_SAMPLE = [("sample", f"""SELECT movieid, moviename, md5(concat('{SAMPLE_SEED}', ':', CAST(movieid AS VARCHAR))) AS sample_key
FROM movieinfo_v ORDER BY sample_key LIMIT 200""")]


@register("random_movie_sample", fx.oracle_with(["movieinfo_v"], "SELECT * FROM sample", SQL_SAMPLE))
def q_random_movie_sample(spark, d):
    """E5: reproducible 200-movie sample (md5 order instead of RAND())."""
    return cat.random_movie_sample(V(spark, d, "movieinfo_v"), 200, SAMPLE_SEED).select(
        "movieid", "moviename", "sample_key")


@register("movie_batches", fx.oracle_with(["movieinfo_v"], """
SELECT movieid, CAST(floor((row_number() OVER (ORDER BY sample_key) - 1) / 30) AS INTEGER) AS batch_index
FROM sample""", SQL_SAMPLE))
def q_movie_batches(spark, d):
    """Batches of 30 over the sample."""
    sample = cat.random_movie_sample(V(spark, d, "movieinfo_v"), 200, SAMPLE_SEED)
    return cat.movie_batches(sample).select("movieid", "batch_index")


@register("genre_list", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid, {S_GENRES('typelist', 3)} AS genres_3, {S_GENRES('typelist', 2)} AS genres_2,
       {S_GENRES('typelist')} AS genres_all FROM movieinfo_v"""))
def q_genre_list(spark, d):
    """First three (cards), first two (rating page) and all genres."""
    return V(spark, d, "movieinfo_v").select(
        "movieid", C.genre_text("typelist", 3).alias("genres_3"), C.genre_text("typelist", 2).alias("genres_2"),
        C.genre_text("typelist").alias("genres_all"))


@register("genre_explode", fx.oracle_with(["movieinfo_v"], """
SELECT movieid, CAST(pos AS INTEGER) AS pos, genre FROM (
  SELECT movieid, unnest(range(len(gl))) AS pos, unnest(gl) AS genre
  FROM (SELECT movieid, list_transform(string_split(typelist, ','), lambda g: trim(g)) AS gl
        FROM movieinfo_v WHERE typelist IS NOT NULL AND typelist <> '') t) u
UNION ALL
SELECT movieid, NULL, NULL FROM movieinfo_v WHERE typelist IS NULL OR typelist = ''"""))
def q_genre_explode(spark, d):
    """One row per (movie, genre); movies without genres keep one NULL row."""
    m = V(spark, d, "movieinfo_v")
    return m.select("movieid", F.posexplode_outer(C.genre_list("typelist")).alias("pos", "genre")).select(
        "movieid", F.col("pos").cast("int").alias("pos"), "genre")


@register("release_year", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid, {S_YEAR('releasetime')} AS release_year FROM movieinfo_v"""))
def q_release_year(spark, d):
    """Year of release or the fixed 'unknown' text."""
    return V(spark, d, "movieinfo_v").select("movieid", C.release_year("releasetime").alias("release_year"))


@register("rating_one_decimal", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid, {S_FIXED('averating')} AS rating_text FROM movieinfo_v"""))
def q_rating_one_decimal(spark, d):
    """``toFixed(1)`` with 0 / NULL shown as 0.0."""
    return V(spark, d, "movieinfo_v").select("movieid", C.to_fixed_1("averating").alias("rating_text"))


@register("default_values", fx.oracle_with(["movieinfo_v"], f"""
SELECT movieid, {S_POSTER('picture')} AS poster, {S_DEFAULT('moviename', C.UNKNOWN_MOVIE)} AS title,
       {S_DEFAULT('director', C.UNKNOWN)} AS director, {S_VOTES('numrating')} AS votes FROM movieinfo_v"""))
def q_default_values(spark, d):
    """Poster placeholder, unknown title / director, zero votes."""
    return V(spark, d, "movieinfo_v").select(
        "movieid", C.poster("picture").alias("poster"), C.or_default("moviename", C.UNKNOWN_MOVIE).alias("title"),
        C.or_default("director", C.UNKNOWN).alias("director"), C.votes("numrating").alias("votes"))


@register("epoch_seconds", """
SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts_seconds FROM events""")
def q_epoch_seconds(spark, d):
    """Event time as epoch seconds (UTC)."""
    return V(spark, d, "events").select("event_id", C.epoch_seconds("ts").alias("ts_seconds"))


# ----------------------------------------------------------------- ratings --

SQL_LATEST_PROGRESS = """
SELECT userid, event_id, ts, progress, step FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY ts DESC, event_id DESC) AS rn FROM progress_v) t
WHERE rn = 1"""
SQL_FAILED_USERS = f"SELECT userid FROM ({SQL_LATEST_PROGRESS}) l WHERE progress = -1"


def failed_users(spark, d):
    """Users whose last recommendation job failed and runs again."""
    return st.progress_latest(V(spark, d, "progress_v")).where(F.col("progress") == -1).select("userid")


@register("filter_user_ratings", fx.oracle_with(["my_ratings_v", "progress_v"], f"""
SELECT * FROM my_ratings_v WHERE userid IN ({SQL_FAILED_USERS})"""))
def q_filter_user_ratings(spark, d):
    """B1: ratings of the users whose last job failed."""
    return rt.filter_user_ratings(V(spark, d, "my_ratings_v"), failed_users(spark, d))


SQL_HISTORY = f"""
SELECT pr.userid, pr.movieid, pr.rating, pr.timestamp, mi.moviename, mi.picture, mi.averating AS avg_rating,
       mi.numrating AS rating_count, mi.typelist, mi.releasetime, mi.director
FROM my_ratings_v pr LEFT JOIN movieinfo_v mi ON pr.movieid = mi.movieid"""


SQL_RATING_HISTORY = fx.oracle_with(["ratings_v", "my_ratings_v", "movieinfo_v"], f"""
SELECT userid, movieid, rating, timestamp, moviename, picture, avg_rating, rating_count, typelist,
       strftime(releasetime, '%Y-%m-%d') AS releasetime, director FROM ({SQL_HISTORY}) h""")


@register("rating_history", SQL_RATING_HISTORY)
def q_rating_history(spark, d):
    """Every user's ratings left-joined to the catalog."""
    h = rt.rating_history(V(spark, d, "my_ratings_v"), V(spark, d, "movieinfo_v"))
    return h.withColumn("releasetime", F.date_format("releasetime", "yyyy-MM-dd"))


@register("rating_history_in_place", SQL_RATING_HISTORY)
def q_rating_history_in_place(spark, d):
    """C3 from tables in shared buckets of the movie: merged where they lie, no exchange at any catalog size."""
    h = _by_movie(spark, d).per_key(lambda t: rt.rating_history(t["ratings"], t["movies"], join_in_place))
    return h.withColumn("releasetime", F.date_format("releasetime", "yyyy-MM-dd"))


@register("history_sorted", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT userid, movieid, rating, timestamp,
       row_number() OVER (PARTITION BY userid ORDER BY timestamp DESC, rating DESC, movieid) AS history_rank
FROM my_ratings_v"""))
def q_history_sorted(spark, d):
    """History order (newest, then highest), as a per-user position."""
    h = rt.history_sorted(V(spark, d, "my_ratings_v"), "newest")
    return h.select("userid", "movieid", "rating", "timestamp", "history_rank")


def _stored_history(spark, d):
    order = [F.col("timestamp").desc(), F.col("rating").desc(), F.col("movieid").asc()]
    return _stored_order(spark, d, "my_ratings_v", "history", order, ["userid"])


@register("history_stored", fx.oracle_with(["my_ratings_v"], """
SELECT userid, movieid, rating, timestamp,
       row_number() OVER (PARTITION BY userid ORDER BY timestamp DESC, rating DESC, movieid) AS history_rank
FROM my_ratings_v"""))
def q_history_stored(spark, d):
    """E3 from the stored order: every position without a shuffle of the ratings, window or checkpoint."""
    return _stored_history(spark, d).positions("history_rank")


@register("history_second_page", fx.oracle_with(["my_ratings_v", "progress_v"], f"""
SELECT userid, movieid, rating, timestamp, history_rank FROM (
  SELECT userid, movieid, rating, timestamp,
         row_number() OVER (PARTITION BY userid ORDER BY timestamp DESC, rating DESC, movieid) AS history_rank
  FROM my_ratings_v) t
WHERE history_rank BETWEEN 11 AND 20 AND userid IN ({SQL_FAILED_USERS})"""))
def q_history_second_page(spark, d):
    """Positions 11 to 20 of the users whose last job failed, from the files that hold them."""
    return _stored_history(spark, d).positions_of(failed_users(spark, d), 11, 20, "history_rank")


@register("history_sort_modes", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT userid, movieid, rating, timestamp,
       row_number() OVER (PARTITION BY userid ORDER BY rating ASC, timestamp DESC, movieid) AS history_rank
FROM my_ratings_v"""))
def q_history_sort_modes(spark, d):
    """The 'lowest first' mode of the history page."""
    h = rt.history_sorted(V(spark, d, "my_ratings_v"), "lowest")
    return h.select("userid", "movieid", "rating", "timestamp", "history_rank")


@register("history_sort_highest", fx.oracle_with(["my_ratings_v"], """
SELECT userid, movieid, rating, timestamp,
       row_number() OVER (PARTITION BY userid ORDER BY rating DESC, timestamp DESC, movieid) AS history_rank
FROM my_ratings_v"""))
def q_history_sort_highest(spark, d):
    """The 'highest first' mode of the history page."""
    h = rt.history_sorted(V(spark, d, "my_ratings_v"), "highest")
    return h.select("userid", "movieid", "rating", "timestamp", "history_rank")


@register("history_display", fx.oracle_with(["ratings_v", "my_ratings_v", "movieinfo_v"], f"""
SELECT userid, movieid AS movie_id, {S_DEFAULT('moviename', C.UNKNOWN_MOVIE)} AS movie_name,
       {S_POSTER('picture')} AS poster, rating AS my_rating, {S_FIXED('avg_rating')} AS average_rating,
       {S_VOTES('rating_count')} AS rating_count, {S_GENRES('typelist', 3)} AS genres,
       {S_YEAR('releasetime')} AS release_year, {S_DEFAULT('director', C.UNKNOWN)} AS director, timestamp
FROM ({SQL_HISTORY}) h"""))
def q_history_display(spark, d):
    """History rows with the page's defaults."""
    h = rt.rating_history(V(spark, d, "my_ratings_v"), V(spark, d, "movieinfo_v"))
    return rt.history_display(h)


@register("rating_stats", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT *, CASE WHEN avg_rating IS NULL THEN '0.0' WHEN (avg_rating * 4) % 2 = 1
               THEN printf('%.1f', (floor(avg_rating * 10) + 1) / 10) ELSE printf('%.1f', avg_rating) END AS avg_text
FROM (
SELECT u.userid, CAST(count(rating) AS BIGINT) AS total_ratings, avg(CAST(rating AS DOUBLE)) AS avg_rating,
       CAST(count(*) FILTER (WHERE rating = 1) AS BIGINT) AS n_1, CAST(count(*) FILTER (WHERE rating = 2) AS BIGINT) AS n_2,
       CAST(count(*) FILTER (WHERE rating = 3) AS BIGINT) AS n_3, CAST(count(*) FILTER (WHERE rating = 4) AS BIGINT) AS n_4,
       CAST(count(*) FILTER (WHERE rating = 5) AS BIGINT) AS n_5
FROM (SELECT userid FROM ratings_v UNION SELECT userid FROM my_ratings_v) u
LEFT JOIN my_ratings_v r ON r.userid = u.userid GROUP BY u.userid) s"""))
def q_rating_stats(spark, d):
    """Count, mean (one decimal) and 1..5 histogram of every user's own ratings, zero rows included."""
    own = V(spark, d, "my_ratings_v")
    return rt.rating_stats(own, V(spark, d, "ratings_v").select("userid").unionByName(own.select("userid")))


@register("rated_ids_limit", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT userid, movieid, pos FROM (
  SELECT userid, movieid, CAST(row_number() OVER (PARTITION BY userid ORDER BY movieid) AS INTEGER) AS pos
  FROM my_ratings_v) t WHERE pos <= 10"""))
def q_rated_ids_limit(spark, d):
    """First ten rated movie ids per user (id order)."""
    return rt.rated_ids_limit(V(spark, d, "my_ratings_v"), 10)


SQL_PAIRS = f"""
SELECT submission_id, userid, CAST(pos AS INTEGER) AS pos,
       {S_PINT("trim(split_part(pair, ':', 1))")} AS movieid, {S_PINT("trim(split_part(pair, ':', 2))")} AS rating
FROM (SELECT submission_id, userid, unnest(range(len(l))) AS pos, unnest(l) AS pair
      FROM (SELECT *, string_split(pairs, ',') AS l FROM submissions_v) a) b
WHERE trim(pair) <> ''"""


@register("delete_rating", fx.oracle_with(["ratings_v", "my_ratings_v", "submissions_v"], f"""
SELECT * FROM my_ratings_v r
WHERE NOT EXISTS (SELECT 1 FROM ({SQL_PAIRS}) p WHERE p.userid = r.userid AND p.movieid = r.movieid)"""))
def q_delete_rating(spark, d):
    """Remove the (user, movie) ratings listed in the users' pair submissions."""
    pairs = rt.parse_pair_ratings(V(spark, d, "submissions_v"))
    return rt.delete_rating(V(spark, d, "my_ratings_v"), pairs)


SQL_BODIES = """
SELECT *, CASE WHEN json_valid(selecteddata) THEN CASE WHEN json_type(selecteddata) = 'ARRAY'
               THEN CAST(json_array_length(selecteddata) AS BIGINT) END END AS n_items FROM submissions_v"""

SQL_JSON_ITEMS = f"""
SELECT submission_id, userid, ts, 'ok' AS parse_status, CAST(i AS INTEGER) AS pos,
       json_extract_string(item, '$.movieid') AS movieid_raw,
       coalesce(json_type(item, '$.movieid') = 'VARCHAR', false) AS movieid_is_string,
       json_extract_string(item, '$.rating') AS rating_raw
FROM (SELECT submission_id, userid, ts, i, json_extract(selecteddata, '$[' || i || ']') AS item
      FROM (SELECT *, unnest(range(n_items)) AS i FROM ({SQL_BODIES}) bodies WHERE n_items > 0) a) b
UNION ALL
SELECT submission_id, userid, ts, CASE WHEN n_items = 0 THEN 'empty' ELSE 'malformed' END, NULL, NULL, false, NULL
FROM ({SQL_BODIES}) bodies WHERE coalesce(n_items, 0) = 0"""

SQL_VALID_ITEMS = f"""
SELECT *, {S_PINT('movieid_raw')} AS movieid, {S_PINT('rating_raw')} AS rating,
       coalesce(CASE WHEN movieid_is_string THEN length(movieid_raw) > 0
                     ELSE movieid_raw IS NOT NULL AND coalesce(TRY_CAST(movieid_raw AS DOUBLE), 1) <> 0 END
                AND (CASE WHEN trim(rating_raw) = '' THEN 0 ELSE TRY_CAST(trim(rating_raw) AS DOUBLE) END) BETWEEN 1 AND 5
                AND {S_PINT('movieid_raw')} IS NOT NULL AND {S_PINT('rating_raw')} IS NOT NULL, false) AS accepted
FROM ({SQL_JSON_ITEMS}) j"""


@register("parse_json_ratings", fx.oracle_with(["submissions_v"], f"""
SELECT submission_id, userid, parse_status, pos, movieid_raw, movieid_is_string, rating_raw FROM ({SQL_JSON_ITEMS}) j"""))
def q_parse_json_ratings(spark, d):
    """G1: JSON submission bodies -> one row per item (types preserved)."""
    items = rt.parse_json_ratings(V(spark, d, "submissions_v"))
    return items.select("submission_id", "userid", "parse_status", "pos", "movieid_raw", "movieid_is_string",
                        "rating_raw")


@register("valid_submissions", fx.oracle_with(["submissions_v"], f"""
SELECT submission_id, userid, pos, movieid, rating FROM ({SQL_VALID_ITEMS}) v WHERE accepted"""))
def q_valid_submissions(spark, d):
    """Accepted items (truthy id, rating 1..5, parseInt of both)."""
    return rt.valid_submissions(V(spark, d, "submissions_v")).select(
        "submission_id", "userid", "pos", "movieid", "rating")


_KIND = "CASE json_type(item, '$.{0}') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' " \
        "WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE CASE WHEN json_type(item, '$.{0}') IS NULL THEN 'missing' ELSE 'number' END END"
SQL_TYPES = f"""
SELECT submission_id, CAST(i AS INTEGER) AS pos, {_KIND.format("movieid")} AS movieid_type, {_KIND.format("rating")} AS rating_type
FROM (SELECT submission_id, i, json_extract(selecteddata, '$[' || i || ']') AS item
      FROM (SELECT *, unnest(range(n_items)) AS i FROM ({SQL_BODIES}) bodies WHERE n_items > 0) a) b"""


@register("rejected_items", fx.oracle_with(["submissions_v"], f"""
SELECT v.submission_id, v.userid, v.pos, t.movieid_type, t.rating_type,
       CASE WHEN (CASE WHEN t.movieid_type = 'string' THEN length(v.movieid_raw) > 0
                       ELSE coalesce(TRY_CAST(v.movieid_raw AS DOUBLE), 0) <> 0 END) AND v.movieid IS NOT NULL
            THEN 'rating' ELSE 'movieid' END AS reason
FROM ({SQL_VALID_ITEMS}) v JOIN ({SQL_TYPES}) t ON t.submission_id = v.submission_id AND t.pos = v.pos
WHERE v.parse_status = 'ok' AND NOT v.accepted"""))
def q_rejected_items(spark, d):
    """Rejected items with the types they were sent in (VARIANT bodies) and the field that failed."""
    return rt.rejected_items(V(spark, d, "submissions_v")).select(
        "submission_id", "userid", "pos", "movieid_type", "rating_type", "reason")


@register("submission_outcome", fx.oracle_with(["submissions_v"], f"""
SELECT userid, submission_id, parse_status, n_accepted, n_rejected,
       CASE WHEN parse_status <> 'ok' THEN 400 WHEN n_accepted = 0 THEN 500 ELSE 200 END AS http_status,
       CASE WHEN parse_status = 'malformed' THEN '{rt.MALFORMED_BODY}' WHEN parse_status = 'empty' THEN '{rt.EMPTY_BODY}'
            WHEN n_accepted = 0 THEN '{rt.NOTHING_SAVED}' ELSE '{rt.SAVED}' END AS message
FROM (SELECT userid, submission_id, max(parse_status) AS parse_status,
             CAST(count(*) FILTER (WHERE accepted) AS BIGINT) AS n_accepted,
             CAST(count(*) FILTER (WHERE parse_status = 'ok' AND NOT accepted) AS BIGINT) AS n_rejected
      FROM ({SQL_VALID_ITEMS}) v GROUP BY userid, submission_id) o"""))
def q_submission_outcome(spark, d):
    """Submit answer: accepted and rejected items, and the status of malformed, empty and fruitless bodies."""
    return rt.submission_outcome(V(spark, d, "submissions_v"))


@register("parse_pair_ratings", fx.oracle_with(["submissions_v"], SQL_PAIRS))
def q_parse_pair_ratings(spark, d):
    """G2: 'id:rating,id:rating' bodies -> rows."""
    return rt.parse_pair_ratings(V(spark, d, "submissions_v")).select(
        "submission_id", "userid", "pos", "movieid", "rating")


@register("zip_scores", fx.oracle_with(["submissions_v"], f"""
SELECT submission_id, userid, len(ids) = len(scores) AS lengths_match, CAST(i AS INTEGER) AS pos,
       {S_PINT('ids[i + 1]')} AS movieid, {S_PINT('scores[i + 1]')} AS moviescore
FROM (SELECT submission_id, userid, ids, scores,
             unnest(CASE WHEN len(ids) = len(scores) AND len(ids) > 0 THEN range(len(ids)) ELSE [NULL] END) AS i
      FROM (SELECT submission_id, userid, regexp_extract_all(pairs, '([0-9]+):', 1) AS ids,
                   regexp_extract_all(pairs, ':([0-9]+)', 1) AS scores FROM submissions_v) a) b"""))
def q_zip_scores(spark, d):
    """Parallel id and score arrays zipped into rows (equal length required)."""
    subs = V(spark, d, "submissions_v").select(
        "submission_id", "userid",
        F.regexp_extract_all("pairs", F.lit(r"(\d+):"), 1).alias("ids"),
        F.regexp_extract_all("pairs", F.lit(r":(\d+)"), 1).alias("scores"))
    return rt.zip_scores(subs, "ids", "scores")


@register("to_json_ratings", fx.oracle_with(["ratings_v", "my_ratings_v"], """
SELECT userid, '[' || string_agg('{"movieid":' || movieid || ',"rating":' || rating || '}', ',' ORDER BY movieid, rating) || ']'
         AS ratings_json,
       CAST(count(*) AS BIGINT) AS n_items
FROM my_ratings_v GROUP BY userid"""))
def q_to_json_ratings(spark, d):
    """Each user's ratings as one JSON array."""
    return rt.to_json_ratings(V(spark, d, "my_ratings_v").select("userid", "movieid", "rating"))


SQL_LATEST_SUB = f"""
SELECT userid, submission_id, ts, n_submissions FROM (
  SELECT userid, submission_id, ts, count(*) OVER (PARTITION BY userid) AS n_submissions,
         row_number() OVER (PARTITION BY userid ORDER BY ts DESC, submission_id DESC) AS rn
  FROM ({SQL_BODIES}) bodies WHERE n_items > 0) t WHERE rn = 1"""


@register("latest_submission", fx.oracle_with(["submissions_v"], f"""
SELECT userid, submission_id, epoch_us(ts) AS ts_us, CAST(n_submissions AS BIGINT) AS n_submissions
FROM ({SQL_LATEST_SUB}) l"""))
def q_latest_submission(spark, d):
    """The newest well-formed submission of every user replaces the earlier ones."""
    latest = rt.latest_submission(rt.well_formed(V(spark, d, "submissions_v")))
    return latest.select("userid", "submission_id", C.epoch_micros("ts").alias("ts_us"), "n_submissions")


SQL_REPLACED = f"""
SELECT userid, movieid, rating, timestamp FROM my_ratings_v
WHERE userid NOT IN (SELECT userid FROM ({SQL_LATEST_SUB}) l)
UNION ALL
SELECT v.userid, v.movieid, v.rating, CAST(epoch_us(v.ts) // 1000000 AS BIGINT) AS timestamp
FROM ({SQL_VALID_ITEMS}) v JOIN ({SQL_LATEST_SUB}) l ON v.submission_id = l.submission_id
WHERE v.accepted"""


@register("submission_replace", fx.oracle_with(["ratings_v", "my_ratings_v", "submissions_v"], SQL_REPLACED))
def q_submission_replace(spark, d):
    """Submit flow (G1 -> B12 -> W4 -> replace): users that submitted keep only
    the accepted items of their newest submission."""
    subs = V(spark, d, "submissions_v")
    latest = rt.latest_submission(rt.well_formed(subs)).select("userid", "submission_id", "ts", "selecteddata")
    items = rt.valid_submissions(latest)
    return rt.replace_user_ratings(V(spark, d, "my_ratings_v"), latest, items)


@register("selection_progress", fx.oracle_with(["submissions_v"], f"""
SELECT submission_id, userid, CAST(n AS INTEGER) AS n_selected, least(n / 10 * 100, 100.0) AS percent,
       CAST(greatest(0, 10 - n) AS INTEGER) AS remaining, n >= 10 AS ready
FROM (SELECT submission_id, userid, coalesce(n_items, 0) AS n FROM ({SQL_BODIES}) bodies) t"""))
def q_selection_progress(spark, d):
    """Selection progress of each submission (minimum ten movies)."""
    subs = V(spark, d, "submissions_v").select(
        "submission_id", "userid",
        F.coalesce(F.size(F.from_json("selecteddata", "array<string>")), F.lit(0)).cast("int").alias("n_selected"))
    return st.selection_progress(subs)


# --------------------------------------------------------------- favourites --

SQL_FAV_JOIN = """
SELECT f.id, f.userid, f.movieid, f.category, f.rating, f.note, f.createtime, m.moviename, m.picture, m.averating, m.typelist,
       m.releasetime, m.director
FROM favorites_v f LEFT JOIN movieinfo_v m ON f.movieid = m.movieid"""


SQL_FAVORITES_LIST = fx.oracle_with(["favorites_v", "movieinfo_v"], f"""
SELECT id, userid, movieid, category, rating, note, epoch_us(createtime) AS createtime_us, moviename, picture, averating,
       typelist, strftime(releasetime, '%Y-%m-%d') AS releasetime, director FROM ({SQL_FAV_JOIN}) j""")


@register("favorites_list", SQL_FAVORITES_LIST)
def q_favorites_list(spark, d):
    """C4: favourites left-joined to the catalog."""
    return _listed(fav.favorites_list(V(spark, d, "favorites_v"), V(spark, d, "movieinfo_v")))


@register("favorites_list_in_place", SQL_FAVORITES_LIST)
def q_favorites_list_in_place(spark, d):
    """C4 from tables in shared buckets of the movie: merged where they lie."""
    return _listed(_by_movie(spark, d).per_key(lambda t: fav.favorites_list(t["favorites"], t["movies"], join_in_place)))


def _listed(listed):
    return listed.select("id", "userid", "movieid", "category", "rating", "note",
                         C.epoch_micros("createtime").alias("createtime_us"), "moviename", "picture", "averating", "typelist",
                         F.date_format("releasetime", "yyyy-MM-dd").alias("releasetime"), "director")


SQL_FAVORITES_SORTED = fx.oracle_with(["favorites_v"], """
SELECT userid, id, epoch_us(createtime) AS createtime_us,
       row_number() OVER (PARTITION BY userid ORDER BY createtime DESC, id DESC) AS list_rank
FROM favorites_v""")


@register("favorites_sorted", SQL_FAVORITES_SORTED)
def q_favorites_sorted(spark, d):
    """Newest favourite first, as a per-user position."""
    listed = fav.favorites_sorted(V(spark, d, "favorites_v"))
    return listed.select("userid", "id", C.epoch_micros("createtime").alias("createtime_us"), "list_rank")


@register("favorites_stored", SQL_FAVORITES_SORTED)
def q_favorites_stored(spark, d):
    """E4 from the stored order: every position without a shuffle of the favourites, window or checkpoint."""
    stored = _stored_order(spark, d, "favorites_v", "favorites", [F.col("createtime").desc(), F.col("id").desc()], ["userid"])
    return stored.positions("list_rank").select("userid", "id", C.epoch_micros("createtime").alias("createtime_us"), "list_rank")


@register("favorites_display", fx.oracle_with(["favorites_v", "movieinfo_v"], f"""
SELECT userid, movieid AS id, {S_DEFAULT('moviename', C.UNKNOWN_MOVIE)} AS title, {S_POSTER('picture')} AS poster,
       {S_FIXED('averating')} AS rating, {S_GENRES('typelist', 3)} AS genres, {S_YEAR('releasetime')} AS release_year,
       {S_DEFAULT('director', C.UNKNOWN)} AS director, epoch_us(createtime) AS added_us
FROM ({SQL_FAV_JOIN}) j"""))
def q_favorites_display(spark, d):
    """Favourites page rows with defaults."""
    return fav.favorites_display(fav.favorites_list(V(spark, d, "favorites_v"), V(spark, d, "movieinfo_v")))


SQL_FAV_REQUESTS = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'want_watch' WHEN 'click' THEN 'watched'
                  WHEN 'purchase' THEN 'liked' WHEN 'signup' THEN '' ELSE event_type END AS category FROM events"""


@register("valid_categories", f"""
SELECT event_id, coalesce(nullif(category, ''), 'liked') AS category_used,
       coalesce(nullif(category, ''), 'liked') IN ('want_watch', 'watched', 'liked') AS is_valid
FROM ({SQL_FAV_REQUESTS}) r""")
def q_valid_categories(spark, d):
    """Category of every favourite request with the default and whitelist."""
    ev = V(spark, d, "events")
    raw = (F.when(F.col("event_type") == "view", "want_watch").when(F.col("event_type") == "click", "watched")
           .when(F.col("event_type") == "purchase", "liked").when(F.col("event_type") == "signup", "")
           .otherwise(F.col("event_type")))
    return fav.valid_categories(ev.select("event_id", raw.alias("category"))).select(
        "event_id", "category_used", "is_valid")


@register("favorites_by_category", fx.oracle_with(["favorites_v"], """
SELECT id, userid, movieid, category FROM favorites_v WHERE category = 'liked'"""))
def q_favorites_by_category(spark, d):
    """Favourites in the 'liked' category."""
    return fav.favorites_by_category(V(spark, d, "favorites_v"), "liked").select("id", "userid", "movieid", "category")


@register("favorite_check", fx.oracle_with(["ratings_v", "recommendations_v", "favorites_v"], """
SELECT r.userid, r.movieid, EXISTS (SELECT 1 FROM favorites_v f WHERE f.userid = r.userid AND f.movieid = r.movieid)
       AS favorited
FROM recommendations_v r"""))
def q_favorite_check(spark, d):
    """Is each recommended movie already a favourite of the user."""
    pairs = V(spark, d, "recommendations_v").select("userid", "movieid")
    return fav.favorite_check(pairs, V(spark, d, "favorites_v"))


CUT = fx.STATE_CUTOFF
SQL_FAV_EVENTS = """
SELECT event_id AS id, CAST(user_id AS INTEGER) AS userid, CAST(json_extract_string(props,'$.k') AS INTEGER) AS movieid,
       CASE event_type WHEN 'view' THEN 'want_watch' WHEN 'click' THEN 'watched' WHEN 'purchase' THEN 'liked' END
         AS category, ts AS createtime
FROM events WHERE event_type IN ('view', 'click', 'purchase')"""


def _fav_events(spark, d):
    return fx._favorite_events(spark, d).where(F.col("category").isNotNull()).select(
        F.col("event_id").alias("id"), "userid", "movieid", "category", F.col("ts").alias("createtime"))


@register("favorites_add", f"""
WITH e AS ({SQL_FAV_EVENTS}),
existing AS (SELECT first(id ORDER BY createtime, id) AS id, userid, movieid, category, min(createtime) AS createtime
             FROM e WHERE createtime < TIMESTAMP '{CUT}' GROUP BY userid, movieid, category),
fresh AS (SELECT first(id ORDER BY createtime, id) AS id, userid, movieid, category, min(createtime) AS createtime
          FROM e WHERE createtime >= TIMESTAMP '{CUT}' GROUP BY userid, movieid, category)
SELECT id, userid, movieid, category, epoch_us(createtime) AS createtime_us FROM existing
UNION ALL
SELECT id, userid, movieid, category, epoch_us(createtime) FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.userid = f.userid AND x.movieid = f.movieid
                  AND x.category = f.category)""")
def q_favorites_add(spark, d):
    """Favourites as of the cutoff, plus later requests whose key is new."""
    events = _fav_events(spark, d)
    cut = F.lit(CUT).cast("timestamp_ntz")
    existing = events.where(F.col("createtime") < cut).groupBy(*fav.KEY).agg(
        F.min(F.struct("createtime", "id")).alias("f")).select("f.id", *fav.KEY, "f.createtime")
    table_after, _ = fav.favorites_add(existing, events.where(F.col("createtime") >= cut))
    return table_after.select("id", *fav.KEY, C.epoch_micros("createtime").alias("createtime_us"))


@register("favorites_add_report", f"""
WITH e AS ({SQL_FAV_EVENTS}),
existing AS (SELECT DISTINCT userid, movieid, category FROM e WHERE createtime < TIMESTAMP '{CUT}'),
req AS (SELECT * FROM e WHERE createtime >= TIMESTAMP '{CUT}'),
first_req AS (SELECT userid, movieid, category, first(id ORDER BY createtime, id) AS first_id FROM req GROUP BY ALL)
SELECT r.id, r.userid, r.movieid, r.category,
       EXISTS (SELECT 1 FROM existing x WHERE x.userid = r.userid AND x.movieid = r.movieid AND x.category = r.category)
       OR r.id <> (SELECT first_id FROM first_req f WHERE f.userid = r.userid AND f.movieid = r.movieid
                   AND f.category = r.category) AS already_exists
FROM req r""")
def q_favorites_add_report(spark, d):
    """C9 report: ``alreadyExists`` for every add request after the cutoff."""
    events = _fav_events(spark, d)
    cut = F.lit(CUT).cast("timestamp_ntz")
    existing = events.where(F.col("createtime") < cut).groupBy(*fav.KEY).agg(
        F.min(F.struct("createtime", "id")).alias("f")).select("f.id", *fav.KEY, "f.createtime")
    _, report = fav.favorites_add(existing, events.where(F.col("createtime") >= cut))
    return report


@register("favorites_remove", fx.oracle_with(["ratings_v", "my_ratings_v", "favorites_v"], """
SELECT id, userid, movieid, category FROM favorites_v f
WHERE NOT EXISTS (SELECT 1 FROM my_ratings_v r WHERE r.rating = 1 AND r.userid = f.userid AND r.movieid = f.movieid)"""))
def q_favorites_remove(spark, d):
    """Drop favourites (all categories) of movies the user rated 1."""
    removals = V(spark, d, "my_ratings_v").where(F.col("rating") == 1)
    return fav.favorites_remove(V(spark, d, "favorites_v"), removals).select("id", "userid", "movieid", "category")


@register("favorites_count", fx.oracle_with(["favorites_v"], """
SELECT userid, CAST(count(*) FILTER (WHERE category = 'want_watch') AS BIGINT) AS want_watch,
       CAST(count(*) FILTER (WHERE category = 'watched') AS BIGINT) AS watched,
       CAST(count(*) FILTER (WHERE category = 'liked') AS BIGINT) AS liked,
       CAST(count(*) AS BIGINT) AS total
FROM favorites_v GROUP BY userid"""))
def q_favorites_count(spark, d):
    """Favourites per category (zero filled) and total, per user."""
    return fav.favorites_count(V(spark, d, "favorites_v"))


@register("favorite_categories", fx.oracle_with(["favorites_v"], """
SELECT userid, movieid, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
FROM favorites_v GROUP BY userid, movieid"""))
def q_favorite_categories(spark, d):
    """Sorted category list per (user, movie)."""
    out = fav.favorite_categories(V(spark, d, "favorites_v"))
    return out.select("userid", "movieid", F.array_join("categories", ",").alias("categories"))


# ------------------------------------------------------------------ status --


@register("progress_latest", fx.oracle_with(["progress_v"], f"""
SELECT userid, event_id, epoch_us(ts) AS ts_us, progress, step FROM ({SQL_LATEST_PROGRESS}) l"""))
def q_progress_latest(spark, d):
    """Last progress state per user."""
    latest = st.progress_latest(V(spark, d, "progress_v"))
    return latest.select("userid", "event_id", C.epoch_micros("ts").alias("ts_us"), "progress", "step")


@register("progress_upsert", fx.oracle_with(["progress_v"], f"""
SELECT userid, event_id, epoch_us(ts) AS ts_us, progress, step FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY (ts >= TIMESTAMP '{CUT}') DESC, ts DESC, event_id DESC) AS rn
  FROM progress_v) t WHERE rn = 1"""))
def q_progress_upsert(spark, d):
    """Progress state as of the cutoff, then every later update replaces
    the row of its user (REPLACE INTO)."""
    log = V(spark, d, "progress_v")
    cut = F.lit(CUT).cast("timestamp_ntz")
    state = st.progress_latest(log.where(F.col("ts") < cut))
    out = st.progress_upsert(state, log.where(F.col("ts") >= cut))
    return out.select("userid", "event_id", C.epoch_micros("ts").alias("ts_us"), "progress", "step")


SQL_ALL_USERS = """
SELECT userid FROM my_ratings_v UNION SELECT userid FROM progress_v UNION SELECT userid FROM recommendations_v"""


def _facts(spark, d):
    """Per-user progress / recommendation / rating facts in one aggregation."""
    return st.user_facts(V(spark, d, "progress_v"), V(spark, d, "recommendations_v"), V(spark, d, "my_ratings_v"))


@register("count_recommendations_by_user", fx.oracle_with(
    ["ratings_v", "my_ratings_v", "progress_v", "recommendations_v"], f"""
SELECT u.userid, CAST(count(r.movieid) AS BIGINT) AS n_recommendations
FROM ({SQL_ALL_USERS}) u LEFT JOIN recommendations_v r ON r.userid = u.userid GROUP BY u.userid"""))
def q_count_recommendations_by_user(spark, d):
    """Stored recommendations per user, zero included."""
    users = V(spark, d, "my_ratings_v").select("userid").unionByName(
        V(spark, d, "progress_v").select("userid")).unionByName(V(spark, d, "recommendations_v").select("userid"))
    return st.count_recommendations_by_user(users, V(spark, d, "recommendations_v"))


SQL_JOB_STATUS = fx.oracle_with(["ratings_v", "my_ratings_v", "progress_v", "recommendations_v"], f"""
SELECT u.userid,
  CASE WHEN p.progress IS NOT NULL AND p.progress >= 100 THEN 'completed'
       WHEN p.progress IS NOT NULL THEN 'processing'
       WHEN coalesce(rc.n, 0) > 0 THEN 'completed'
       WHEN coalesce(rt.n, 0) > 0 THEN 'processing' ELSE 'no_data' END AS status,
  CAST(CASE WHEN p.progress IS NOT NULL AND p.progress >= 100 THEN 100
       WHEN p.progress IS NOT NULL THEN p.progress
       WHEN coalesce(rc.n, 0) > 0 THEN 100
       WHEN coalesce(rt.n, 0) > 0 THEN 50 ELSE 0 END AS INTEGER) AS progress,
  CAST(CASE WHEN (p.progress IS NOT NULL AND p.progress >= 100) OR (p.progress IS NULL AND coalesce(rc.n, 0) > 0)
       THEN coalesce(rc.n, 0) END AS BIGINT) AS rec_count,
  CASE WHEN p.progress IS NOT NULL AND p.progress >= 100 THEN coalesce(nullif(p.step, ''), '{st.DONE_STEP}')
       WHEN p.progress IS NOT NULL THEN coalesce(nullif(p.step, ''), '{st.RUNNING_STEP}')
       WHEN coalesce(rc.n, 0) > 0 THEN '{st.DONE_STEP}' WHEN coalesce(rt.n, 0) > 0 THEN '{st.RUNNING_STEP}'
       ELSE '{st.NO_DATA_STEP}' END AS step,
  CASE WHEN (p.progress IS NOT NULL AND p.progress >= 100) OR (p.progress IS NULL AND coalesce(rc.n, 0) > 0)
       THEN '{st.DONE_MESSAGE[0]}' || coalesce(rc.n, 0) || '{st.DONE_MESSAGE[1]}'
       WHEN p.progress IS NOT NULL THEN coalesce(nullif(p.step, ''), '{st.RUNNING_MESSAGE}')
       WHEN coalesce(rt.n, 0) > 0 THEN '{st.RUNNING_MESSAGE}' ELSE '{st.NO_DATA_MESSAGE}' END AS message,
  coalesce(p.progress = -1, false) AS failed
FROM ({SQL_ALL_USERS}) u
LEFT JOIN ({SQL_LATEST_PROGRESS}) p ON p.userid = u.userid
LEFT JOIN (SELECT userid, count(*) AS n FROM recommendations_v GROUP BY userid) rc ON rc.userid = u.userid
LEFT JOIN (SELECT userid, count(*) AS n FROM my_ratings_v GROUP BY userid) rt ON rt.userid = u.userid""")


@register("job_status", SQL_JOB_STATUS)
def q_job_status(spark, d):
    """Detailed job status of every user."""
    return st.job_status(_facts(spark, d))


def _by_user(spark, d):
    def tables():
        held = {"progress": V(spark, d, "progress_v"), "recs": V(spark, d, "recommendations_v"), "ratings": V(spark, d, "my_ratings_v")}
        return {**held, "users": reduce(DataFrame.union, [t.select("userid") for t in held.values()]).distinct()}

    return _colocated(spark, d, "by-user", "userid", tables)


@register("job_status_in_place", SQL_JOB_STATUS)
def q_job_status_in_place(spark, d):
    """S1 from tables in shared buckets of the user: aggregated and joined where they lie."""
    return _by_user(spark, d).per_key(
        lambda t: st.job_status(st.user_facts_of(t["users"], t["progress"], t["recs"], t["ratings"])))


@register("job_status_simple", fx.oracle_with(["ratings_v", "my_ratings_v", "progress_v", "recommendations_v"], f"""
SELECT u.userid, CASE WHEN p.progress >= 100 THEN 'completed' ELSE 'running' END AS status,
       CAST(coalesce(p.progress, 0) AS INTEGER) AS progress,
       CASE WHEN p.progress IS NULL THEN '{st.STARTING_MESSAGE}' ELSE p.step END AS message
FROM ({SQL_ALL_USERS}) u LEFT JOIN ({SQL_LATEST_PROGRESS}) p ON p.userid = u.userid"""))
def q_job_status_simple(spark, d):
    """Simple running / completed status of every user."""
    return st.job_status_simple(_facts(spark, d))


_STAGES_SQL = ", ".join(f"({p}, '{label}')" for p, label in st.STAGES)


@register("progress_stages", fx.oracle_with(["progress_v"], f"""
SELECT p.userid, p.event_id, p.progress, s.stage_label
FROM progress_v p LEFT JOIN (VALUES {_STAGES_SQL}) s(stage_progress, stage_label) ON p.progress = s.stage_progress"""))
def q_progress_stages(spark, d):
    """S3: progress rows labelled with the job stage they denote."""
    return st.progress_stages(V(spark, d, "progress_v")).select("userid", "event_id", "progress", "stage_label")


@register("progress_monotone", fx.oracle_with(["progress_v"], """
SELECT userid, event_id, progress,
       greatest(10, max(progress) OVER (PARTITION BY userid ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS shown_progress
FROM progress_v"""))
def q_progress_monotone(spark, d):
    """Progress bar that never goes back, starting at 10."""
    return st.progress_monotone(V(spark, d, "progress_v")).select("userid", "event_id", "progress", "shown_progress")


# ---------------------------------------------------- stored recommendations --

@register("recommendations_with_info", fx.oracle_with(["ratings_v", "recommendations_v", "movieinfo_v"], """
SELECT r.userid, r.movieid, r.degree, m.moviename, m.picture
FROM recommendations_v r JOIN movieinfo_v m ON r.movieid = m.movieid"""))
def q_recommendations_with_info(spark, d):
    """Stored recommendations with catalog details."""
    m = V(spark, d, "movieinfo_v").select("movieid", "moviename", "picture")
    return join_dimension(V(spark, d, "recommendations_v"), m, "movieid")


@register("home_recommendations", fx.oracle_with(["ratings_v", "recommendations_v", "movieinfo_v"], """
SELECT userid, movieid, moviename, picture, averating, typelist, home_rank FROM (
  SELECT r.userid, m.movieid, m.moviename, m.picture, m.averating, m.typelist,
         CAST(row_number() OVER (PARTITION BY r.userid ORDER BY r.degree DESC, m.movieid) AS INTEGER) AS home_rank
  FROM recommendations_v r JOIN movieinfo_v m ON r.movieid = m.movieid) t WHERE home_rank <= 8"""))
def q_home_recommendations(spark, d):
    """Eight best stored recommendations per user for the home page."""
    m = V(spark, d, "movieinfo_v").select("movieid", "moviename", "picture", "averating", "typelist")
    joined = join_dimension(V(spark, d, "recommendations_v"), m, "movieid")
    top = rec.top_n_per_group(joined, "userid", [F.desc("degree"), F.asc("movieid")], 8, "home_rank")
    return top.select("userid", "movieid", "moviename", "picture", "averating", "typelist",
                      F.col("home_rank").cast("int").alias("home_rank"))
