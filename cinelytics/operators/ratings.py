"""Personal ratings and rating submissions: history, statistics, parsing of the
two submission formats, validation, replacement of a user's ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import join_dimension
from ..plans.ranking import row_number_within

# --- Fixed values -------------------------------------------------------------
HISTORY_MODES = {  # sort buttons of the history page: (column, descending)
    "newest": (("timestamp", True), ("rating", True)),
    "highest": (("rating", True), ("timestamp", True)),
    "lowest": (("rating", False), ("timestamp", True)),
}
MALFORMED_BODY = "评分数据格式错误"
EMPTY_BODY = "评分数据为空"
NOTHING_SAVED = "所有评分插入均失败"
SAVED = "评分保存成功"
# -----------------------------------------------------------------------------


def filter_user_ratings(ratings: DataFrame, users) -> DataFrame:
    """Rows of one user (an int) or of a set of users (a frame with ``userid``)."""
    if isinstance(users, DataFrame):
        return join_dimension(ratings, users.select("userid").distinct(), "userid", "left_semi")
    return ratings.where(F.col("userid") == F.lit(int(users)))


def rating_history(personal: DataFrame, catalog: DataFrame, join=join_dimension) -> DataFrame:
    """Personal ratings left-joined to the catalog (the history page's rows); ``join``:
    ``join_in_place`` for tables stored in the same buckets."""
    cat = catalog.select(
        "movieid", "moviename", "picture", F.col("averating").alias("avg_rating"),
        F.col("numrating").alias("rating_count"), "typelist", "releasetime", "director",
    )
    return join(personal, cat, "movieid", "left")


def history_sorted(history: DataFrame, mode: str = "newest") -> DataFrame:
    """Number each user's rows in the page's order (``newest``: time then
    rating, ``highest``, ``lowest``; ties by movie id), for any user size."""
    spec = HISTORY_MODES.get(mode, HISTORY_MODES["newest"])
    order = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in spec] + [F.col("movieid").asc()]
    return row_number_within(history, ["userid"], order, "history_rank")


def history_display(history: DataFrame) -> DataFrame:
    """Display projection of the history page with its defaults."""
    return history.select(
        "userid",
        F.col("movieid").alias("movie_id"),
        C.or_default("moviename", C.UNKNOWN_MOVIE).alias("movie_name"),
        C.poster("picture").alias("poster"),
        F.col("rating").alias("my_rating"),
        C.to_fixed_1("avg_rating").alias("average_rating"),
        C.votes("rating_count").alias("rating_count"),
        C.genre_text("typelist", 3).alias("genres"),
        C.release_year("releasetime").alias("release_year"),
        C.or_default("director", C.UNKNOWN).alias("director"),
        F.col("timestamp"),
    )


def rating_stats(personal: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user: count, mean (also as the page shows it, with one decimal), and
    the 1..5 histogram (zero filled).  With ``users``, one row for each of them:
    zero counts and ``0.0`` for a user without ratings."""
    r = F.col("rating")
    stats = personal.groupBy("userid").agg(
        F.count(F.lit(1)).alias("total_ratings"),
        F.avg(r.cast("double")).alias("avg_rating"),
        *[F.count_if(r == k).alias(f"n_{k}") for k in range(1, 6)],
    )
    if users is not None:
        stats = users.select("userid").distinct().join(stats, "userid", "left").fillna(
            0, subset=["total_ratings", *(f"n_{k}" for k in range(1, 6))])
    return stats.withColumn("avg_text", C.mean_to_fixed_1("avg_rating"))


def rated_ids_limit(personal: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rated movie ids per user, in id order (the original LIMIT had
    no order; a per-user top-n is evaluated with a group limit before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy("userid").orderBy("movieid")
    return personal.select("userid", "movieid").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def delete_rating(personal: DataFrame, deletions: DataFrame) -> DataFrame:
    """Remove the (user, movie) pairs listed in ``deletions``."""
    pairs = deletions.select("userid", "movieid").distinct()
    return personal.join(pairs, ["userid", "movieid"], "left_anti").select(*personal.columns)


# ----------------------------------------------------------- submissions --

def parse_json_ratings(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """``[{"movieid":..,"rating":..}, ...]`` -> one row per item.

    Items are kept as raw JSON text first so the type of ``movieid`` survives
    (a JSON string is truthy when non-empty, a number when non-zero).  A body
    that is not a JSON array gives one row with ``parse_status = 'malformed'``,
    an empty array one row with ``'empty'``."""
    text = F.trim(F.col(json_col))
    arr = F.when(text.startswith("["), F.from_json(F.col(json_col), "array<string>"))
    status = F.when(arr.isNull(), "malformed").when(F.size(arr) == 0, "empty").otherwise("ok")
    base = subs.withColumn("parse_status", status).withColumn("__items", arr)
    items = base.select("*", F.posexplode_outer("__items").alias("pos", "item_json")).drop("__items")
    mid = F.get_json_object("item_json", "$.movieid")
    rating = F.get_json_object("item_json", "$.rating")
    mid_is_string = F.coalesce(F.col("item_json").rlike(r'"movieid"\s*:\s*"'), F.lit(False))
    return items.select(
        *[c for c in subs.columns if c != json_col], "parse_status",
        F.when(F.col("parse_status") == "ok", F.col("pos")).cast("int").alias("pos"),
        mid.alias("movieid_raw"), mid_is_string.alias("movieid_is_string"), rating.alias("rating_raw"),
    )


def validate_json_items(items: DataFrame) -> DataFrame:
    """Add ``accepted``, ``movieid`` and ``rating`` (``parseInt`` of each).

    Rule of the original insert loop: movieid truthy, ``rating >= 1 and <= 5``
    after number coercion, both parse to integers."""
    raw = F.col("movieid_raw")
    truthy = F.when(F.col("movieid_is_string"), F.length(raw) > 0).otherwise(
        raw.isNotNull() & (raw != "false") & (raw != "null") & (F.coalesce(raw.try_cast("double"), F.lit(1.0)) != 0)
    )
    rnum = C.js_to_number("rating_raw")
    movieid, rating = C.js_parse_int(raw), C.js_parse_int("rating_raw")
    ok = (F.col("parse_status") == "ok") & truthy & rnum.between(1, 5) & movieid.isNotNull() & rating.isNotNull()
    return items.withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn(
        "movieid", movieid).withColumn("rating", rating)


def variant_items(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """Bodies read as VARIANT: the columns of ``parse_json_ratings``, and for every item its
    value ``item`` as sent (nested values survive) with the JSON types of its two fields
    (``string``, ``number``, ``boolean``, ``object``, ``array``, ``null``, ``missing``).

    A number counts by its value (``1e2`` is 100).  A body in which an object repeats a key
    is malformed: VARIANT holds a key once."""
    values = F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>")
    status = F.when(values.isNull(), "malformed").when(F.size(values) == 0, "empty").otherwise("ok")
    items = subs.withColumns({"parse_status": status, "__items": values}).select(
        "*", F.posexplode_outer("__items").alias("pos", "item"))
    fields = {f: F.try_variant_get("item", f"$.{f}", "variant") for f in ("movieid", "rating")}
    text = {f: F.when(~_json_type(v).isin("object", "array"), F.try_variant_get(v, "$", "string")) for f, v in fields.items()}
    return items.select(
        *[c for c in subs.columns if c != json_col], "parse_status",
        F.when(F.col("parse_status") == "ok", F.col("pos")).cast("int").alias("pos"), "item",
        text["movieid"].alias("movieid_raw"), (_json_type(fields["movieid"]) == "string").alias("movieid_is_string"),
        text["rating"].alias("rating_raw"),
        *[F.when(F.col("parse_status") == "ok", _json_type(v)).alias(f"{f}_type") for f, v in fields.items()],
    )


def _json_type(value):
    """The JSON type of a VARIANT."""
    name = F.schema_of_variant(value)
    return (F.when(value.isNull(), "missing").when(name == "VOID", "null").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "array")
            .when(name.startswith("OBJECT"), "object").otherwise("number"))


def rejected_items(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """The items of well-formed bodies that are not accepted, with their value as sent, the
    types of their fields and the field that failed first."""
    items = validate_json_items(variant_items(subs, json_col)).where((F.col("parse_status") == "ok") & ~F.col("accepted"))
    truthy = F.coalesce(F.when(F.col("movieid_type") == "string", F.length("movieid_raw") > 0)
                        .otherwise(F.col("movieid_raw").try_cast("double") != 0), F.lit(False))
    reason = F.when(~truthy | F.col("movieid").isNull(), "movieid").otherwise("rating")
    keep = [c for c in subs.columns if c != json_col]
    return items.select(*keep, "pos", "item", "movieid_type", "rating_type", reason.alias("reason"))


def valid_submissions(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """Accepted items only: (submission columns, pos, movieid, rating)."""
    items = validate_json_items(parse_json_ratings(subs, json_col)).where("accepted")
    keep = [c for c in subs.columns if c != json_col]
    return items.select(*keep, "pos", "movieid", "rating")


def parse_pair_ratings(subs: DataFrame, pairs_col: str = "pairs") -> DataFrame:
    """``'id:rating,id:rating'`` -> one row per pair (duplicate ids kept)."""
    exploded = subs.select("*", F.posexplode(F.split(F.col(pairs_col), ",")).alias("pos", "__pair"))
    exploded = exploded.where(F.trim("__pair") != "")
    parts = F.split(F.col("__pair"), ":")
    return exploded.select(
        *[c for c in subs.columns if c != pairs_col], F.col("pos").cast("int").alias("pos"),
        C.js_parse_int(F.trim(parts.getItem(0))).alias("movieid"),
        C.js_parse_int(F.trim(parts.getItem(1))).alias("rating"),
    )


def zip_scores(df: DataFrame, ids_col: str, scores_col: str) -> DataFrame:
    """Parallel id / score arrays -> (pos, movieid, moviescore) rows; rows whose
    arrays differ in length are rejected (``lengths_match = false``, no items)."""
    same = F.size(ids_col) == F.size(scores_col)
    zipped = F.when(same, F.arrays_zip(F.col(ids_col).alias("movieid"), F.col(scores_col).alias("moviescore")))
    out = df.withColumn("lengths_match", same).select(
        "*", F.posexplode_outer(zipped).alias("pos", "__z")
    )
    return out.select(
        *[c for c in df.columns if c not in (ids_col, scores_col)], "lengths_match",
        F.col("pos").cast("int").alias("pos"),
        C.js_parse_int("__z.movieid").alias("movieid"), C.js_parse_int("__z.moviescore").alias("moviescore"),
    )


def to_json_ratings(personal: DataFrame) -> DataFrame:
    """Per user, one JSON array of ``{movieid, rating}`` sorted by movie id; a user's
    selection on one page, so its size is bounded by the catalog."""
    return personal.groupBy("userid").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("movieid", "rating")))).alias("ratings_json"),
        F.count(F.lit(1)).alias("n_items"),
    )


def submission_outcome(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """One row per submission: the endpoint's answer.  A malformed or empty body
    is 400 and changes nothing; a body without an accepted item is 500 (its user's
    ratings are gone); any other is 200.  With items accepted and rejected."""
    items = validate_json_items(parse_json_ratings(subs, json_col))
    keep = [c for c in ("userid", "submission_id") if c in subs.columns]
    per = items.groupBy(*keep).agg(
        F.max("parse_status").alias("parse_status"),
        F.count_if(F.col("accepted")).alias("n_accepted"),
        F.count_if((F.col("parse_status") == "ok") & ~F.col("accepted")).alias("n_rejected"),
    )
    bad, none = F.col("parse_status") != "ok", F.col("n_accepted") == 0
    return per.withColumn("http_status", F.when(bad, 400).when(none, 500).otherwise(200)).withColumn(
        "message", F.when(F.col("parse_status") == "malformed", MALFORMED_BODY)
        .when(bad, EMPTY_BODY).when(none, NOTHING_SAVED).otherwise(SAVED))


def well_formed(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """Submissions whose body is a JSON array with an item.  The original rejects any
    other body before it deletes anything, so such a body must never become a user's
    newest submission; a well-formed one without an accepted item still replaces."""
    arr = F.when(F.trim(F.col(json_col)).startswith("["), F.from_json(F.col(json_col), "array<string>"))
    return subs.where(F.coalesce(F.size(arr), F.lit(0)) > 0)


def latest_submission(subs: DataFrame, ts_col: str = "ts", id_col: str = "submission_id") -> DataFrame:
    """The newest submission per user (by ts, then id) — a partial aggregate, so
    a user with many submissions never lands in one task as a whole."""
    payload = [c for c in subs.columns if c != "userid"]
    agg = subs.groupBy("userid").agg(
        F.max_by(F.struct(*payload), F.struct(ts_col, id_col)).alias("__latest"),
        F.count(F.lit(1)).alias("n_submissions"),
    )
    return agg.select("userid", "__latest.*", "n_submissions")


def replace_user_ratings(personal: DataFrame, submitted_users: DataFrame, accepted_items: DataFrame,
                         ts_col: str = "ts") -> DataFrame:
    """Submission semantics: every user that submitted loses all old ratings
    (even when no item of the submission is accepted) and gets the accepted
    items of the newest submission (delete-then-insert)."""
    kept = personal.join(submitted_users.select("userid").distinct(), "userid", "left_anti")
    new = accepted_items.select("userid", "movieid", "rating", C.epoch_seconds(ts_col).alias("timestamp"))
    return kept.unionByName(new)
