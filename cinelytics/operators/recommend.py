"""Ranking and recommendation without a user x catalog cross product.

The original job scores *every* catalog movie the user has not rated and keeps
the ten best.  Done for all users that is a users x catalog product, which does
not survive 100 TB.  When the score does not depend on the user (the popularity
predictor, or any global item score) the same answer comes from a linear-size
plan:

1. rank the eligible catalog once, globally: 1..M by (score desc, movieid asc);
2. cut the ranks into blocks of 64 and keep, per (user, block), one word with a
   bit per seen rank (``bit_or``: a partial aggregate that also drops repeated
   pairs).  Before block b there are 64 b minus the set bits of the user's
   earlier words unseen ranks, so a running sum tells which blocks hold the n
   best unseen ranks: stored blocks with fewer than n unseen before them, and
   the first blocks of the gaps between stored ones;
3. read the answers off the clear bits of these few words, and map ranks back to
   movies with a size-checked dimension join.

The running sum is a window per user over its words, at most M / 64 rows of two
numbers however many ratings the user has.  Nothing is fanned out per seen row.

User-dependent scores (ALS) go through ``model.recommend_for_users``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TOP_N, is_positive_prediction
from ..plans.joins import join_dimension
from ..plans.ranking import global_rank_with_count


WORD = 64  # ranks per block: the bits of a long


def rank_catalog(scores: DataFrame, score_col: str = "prediction", item_col: str = "movieid") -> tuple[DataFrame, int]:
    """Positive, finite scores ranked 1..M by (score desc, item asc); also M."""
    eligible = scores.where(is_positive_prediction(score_col))
    return global_rank_with_count(eligible, [F.desc(score_col), F.asc(item_col)], "catalog_rank")


def top_unseen_per_user(
    users: DataFrame | None,
    seen: DataFrame,
    scores: DataFrame,
    n: int = TOP_N,
    user_col: str = "userid",
    item_col: str = "movieid",
    score_col: str = "prediction",
) -> DataFrame:
    """For every user in ``users`` (``None``: every user in ``seen``): the ``n``
    best catalog items (by a user-independent ``score_col``; only positive,
    finite scores) that the user has not seen.

    Output: user, item, score, ``rank`` (1..n within the user) and every other
    column of ``scores`` (e.g. the title)."""
    ranked, n_ranked = rank_catalog(scores, score_col, item_col)
    pairs = seen.select(user_col, item_col)
    if users is not None:
        wanted = users.select(user_col).distinct()
        pairs = join_dimension(pairs, wanted, user_col, "left_semi")
    seen_ranks = join_dimension(pairs, ranked.select(item_col, "catalog_rank"), item_col, "left", dim_rows=n_ranked)
    place = F.col("catalog_rank") - 1
    bits = seen_ranks.select(  # block -1: a user whose seen movies have no rank
        user_col, F.coalesce(F.floor(place / WORD), F.lit(-1)).cast("long").alias("__block"),
        F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int")),
                   F.lit(0)).cast("long").alias("__bits"))
    if users is not None:
        bits = bits.unionByName(wanted.select(
            user_col, F.lit(-1).cast("long").alias("__block"), F.lit(0).cast("long").alias("__bits")))
    words = bits.groupBy(user_col, "__block").agg(F.bit_or("__bits").alias("__bits"))

    last_block, gap = (n_ranked - 1) // WORD, -(-n // WORD)  # that many whole gap blocks hold n unseen ranks
    order = Window.partitionBy(user_col).orderBy("__block")
    block, before = F.col("__block"), F.col("__seen") - F.bit_count("__bits")
    next_block = F.coalesce(F.lead("__block").over(order), F.lit(last_block + 1))
    words = words.select(
        user_col, "__block", "__bits", next_block.alias("__next"), F.lag("__block").over(order).alias("__prev"),
        F.sum(F.bit_count("__bits")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__seen"))

    def gap_words(first, last, seen_before):
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda c: F.struct(
            c.alias("block"), F.lit(0).cast("long").alias("bits"), (c * WORD - seen_before).alias("before"))))

    no_words = F.array().cast("array<struct<block:bigint,bits:bigint,before:bigint>>")
    none = F.lit(0).cast("long")
    head = F.when(F.col("__prev").isNull(), gap_words(none, F.least(F.lit(gap), block) - 1, none))
    own = F.when(block >= 0, F.array(F.struct(
        block.alias("block"), F.col("__bits").alias("bits"), (block * WORD - before).alias("before"))))
    tail = gap_words(block + 1, F.least(block + gap, F.col("__next") - 1), F.col("__seen"))
    parts = F.concat(*[F.coalesce(p, no_words) for p in (head, own, tail)])
    few = words.select(user_col, F.explode(F.filter(parts, lambda w: w["before"] < n)).alias("w"))
    free = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda x: (F.getbit("w.bits", x) == 0) & (
        F.col("w.block") * WORD + x < n_ranked))
    best = few.select(user_col, "w", F.posexplode(free).alias("__i", "__x")).select(
        user_col, (F.col("w.before") + F.col("__i") + 1).cast("int").alias("rank"),
        (F.col("w.block") * WORD + F.col("__x") + 1).alias("catalog_rank")).where(F.col("rank") <= n)
    return join_dimension(best, ranked, "catalog_rank", dim_rows=n_ranked).drop("catalog_rank")


def top_n_overall(scores: DataFrame, n: int = TOP_N, score_col: str = "prediction", item_col: str = "movieid") -> DataFrame:
    """``sortBy(-prediction).take(n)`` with a tie-break: a distributed top-k
    (TakeOrderedAndProject), positive finite scores only."""
    return scores.where(is_positive_prediction(score_col)).orderBy(F.desc(score_col), F.asc(item_col)).limit(n)


def top_n_per_group(df: DataFrame, group_col: str, order_cols, n: int, rank_col: str = "rank") -> DataFrame:
    """``row_number() <= n`` per group (Spark plans a group limit before the shuffle)."""
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def unseen_candidate_counts(users: DataFrame, seen: DataFrame, catalog: DataFrame,
                            user_col: str = "userid", item_col: str = "movieid") -> DataFrame:
    """Size of each user's candidate set (catalog minus rated movies) without
    materialising it: |catalog| - |rated movies that are in the catalog|."""
    ids = catalog.select(item_col).distinct()
    rated_in_catalog = join_dimension(seen.select(user_col, item_col).distinct(), ids, item_col, "left_semi")
    per_user = rated_in_catalog.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_rated_in_catalog"))
    total = ids.select(F.count(F.lit(1))).scalar()
    return (
        users.select(user_col).distinct()
        .join(per_user, user_col, "left")
        .fillna(0, subset=["n_rated_in_catalog"])
        .select(user_col, F.col("n_rated_in_catalog").cast("long").alias("n_rated_in_catalog"),
                (total - F.col("n_rated_in_catalog")).cast("long").alias("n_candidates"))
    )


def with_titles(df: DataFrame, catalog: DataFrame, item_col: str = "movieid", title_col: str = "moviename") -> DataFrame:
    """Result id -> title (inner, like the original map lookup on ids that come
    from the same catalog)."""
    return join_dimension(df, catalog.select(item_col, title_col), item_col)


def user_catalog_pairs(catalog: DataFrame, userid: int, user_col: str = "userid", item_col: str = "movieid") -> DataFrame:
    """The original "constant user x all movies" step for one user: the catalog
    projected with a literal user column (a scan of the catalog, not a join).
    For many users use ``top_unseen_per_user`` / ``model.recommend_for_users``,
    which never build the users x catalog product."""
    return catalog.select(F.lit(int(userid)).cast("int").alias(user_col), F.col(item_col))
