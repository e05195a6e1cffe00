"""Rating preparation: positive filter, timestamp-digit split, counts, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")
MIN_VALIDATION_ROWS = 10  # below this the original job prints a warning


def positive_ratings(df: DataFrame, rating_col: str = "rating", require_nonempty: bool = False) -> DataFrame:
    """Keep ``rating > 0``; optionally fail like the original loader when nothing is left."""
    # Spark orders NaN above every number
    out = df.where((F.col(rating_col) > 0) & ~F.isnan(F.col(rating_col).cast("double")))
    if require_nonempty and out.isEmpty():
        raise ValueError("No ratings provided.")
    return out


def split_label(ts_col: str = "ts"):
    """``ts % 10`` (truncated remainder, so negative stamps land in train):
    < 6 train, 6..7 validation, >= 8 test."""
    digit = F.col(ts_col) % 10
    return F.when(digit < 6, "train").when(digit < 8, "validation").otherwise("test")


def time_mod_split(df: DataFrame, ts_col: str = "ts", out_col: str = "split") -> DataFrame:
    """One frame with a ``split`` label instead of three filtered copies."""
    return df.withColumn(out_col, split_label(ts_col))


def split_part(df: DataFrame, part: str, ts_col: str = "ts") -> DataFrame:
    if part not in SPLITS:
        raise ValueError(f"unknown split {part!r}")
    return df.where(split_label(ts_col) == part)


def dataset_stats(ratings: DataFrame, user_col: str = "userid", item_col: str = "movieid") -> DataFrame:
    """#ratings, #distinct users, #distinct movies in one aggregation pass."""
    return ratings.agg(
        F.count(F.lit(1)).alias("num_ratings"),
        F.countDistinct(user_col).alias("num_users"),
        F.countDistinct(item_col).alias("num_movies"),
    )


def split_counts(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split with zero fill, and the original job's guard flags."""
    return count_flags(split_df, split_col)


def count_flags(df: DataFrame, split_col: str = "split", n_col: str | None = None) -> DataFrame:
    """Rows (or the sum of ``n_col``) per split label with zero fill and the flags."""
    # one global aggregate with a conditional count per label, unpivoted to rows:
    # no join, and labels without rows get 0
    def total(s):
        here = F.col(split_col) == s
        return F.count_if(here) if n_col is None else F.coalesce(F.sum(F.when(here, F.col(n_col))), F.lit(0))

    counts = df.agg(*[total(s).alias(s) for s in SPLITS])
    out = counts.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(s).alias("n_rows")) for s in SPLITS
    ])).alias("__r")).select("__r.*")
    flag = ((F.col("split") == "train") & (F.col("n_rows") == 0)) | (
        (F.col("split") == "validation") & (F.col("n_rows") < MIN_VALIDATION_ROWS)
    )
    return out.select("split", F.col("n_rows").cast("long").alias("n_rows"), flag.alias("flagged"))


def training_union(train: DataFrame, own_ratings: DataFrame) -> DataFrame:
    """Sample training rows plus all of the user's own positive ratings (a bag union)."""
    cols = ["userid", "movieid", "rating"]
    own = positive_ratings(own_ratings).select(
        "userid", "movieid", F.col("rating").cast("double").alias("rating")
    )
    return train.select(*cols).unionByName(own)


def train_validation_union(train: DataFrame, validation: DataFrame) -> DataFrame:
    cols = ["userid", "movieid", "rating"]
    return train.select(*cols).unionByName(validation.select(*cols))
