"""``::``-delimited text: the original ``ratings.dat`` / ``movies.dat`` files and
the ``u::m::r::title`` record strings passed between the original modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed formats ------------------------------------------------------------
SEP = "::"
RATINGS_SCHEMA = "user INT, product INT, rating DOUBLE, ts BIGINT"
MOVIES_SCHEMA = "movieid INT, moviename STRING, genres STRING"
GENRE_SEP = "|"
# -----------------------------------------------------------------------------


def _reader(spark: SparkSession, schema: str):
    # quote "" disables quoting: a leading '"' in a title must not swallow the separator
    return spark.read.schema(schema).option("sep", SEP).option("quote", "").option("header", "false") \
        .option("mode", "PERMISSIVE")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user::movie::rating::timestamp`` lines -> typed columns (splittable text scan)."""
    return _reader(spark, RATINGS_SCHEMA).csv(path)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """``id::title[::genres]`` lines; a missing genres field is NULL, extra
    fields are ignored (the original used fields 0 and 1 only)."""
    return _reader(spark, MOVIES_SCHEMA).csv(path)


def encode_records(df: DataFrame, cols: Sequence[str | Column], out_col: str = "record") -> DataFrame:
    """Typed row -> ``a::b::c`` string.  ``concat_ws`` skips NULLs, so every field
    is coalesced to '' first to keep positions stable."""
    fields = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return df.select(F.concat_ws(SEP, *fields).alias(out_col))


def decode_records(df: DataFrame, schema: Sequence[tuple[str, str]], in_col: str = "record") -> DataFrame:
    """``a::b::c`` string -> typed columns (trimmed; bad values become NULL)."""
    parts = F.split(F.col(in_col), SEP)
    return df.select(*[
        F.nullif(F.trim(parts.getItem(i)), F.lit("")).try_cast(t).alias(name)
        for i, (name, t) in enumerate(schema)
    ])


def movies_dat_lines(catalog: DataFrame) -> DataFrame:
    """``movieinfo`` -> ``movies.dat`` lines (``id::title::Genre|Genre``)."""
    from ..functions.columns import genre_text

    return encode_records(catalog, ["movieid", "moviename", genre_text("typelist", sep=GENRE_SEP)], "value")


def write_lines(df: DataFrame, path: str, col: str = "value") -> None:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
