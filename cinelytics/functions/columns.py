"""Column -> Column helpers (all built-in expressions, codegen friendly).

They reproduce the display and validation rules of the original web pages:
JavaScript truthiness (``0`` and ``NULL`` are both "missing"), ``parseInt``
prefix parsing, ``toFixed(1)``, the first-n genre lists, and the NaN traps of
Spark SQL (``NaN > 0`` is true and NaN sorts first on DESC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the original application's output) -------------
UNKNOWN = "未知"  # "unknown": missing year / director
UNKNOWN_MOVIE = "未知电影"  # "unknown movie": missing title
NO_POSTER = "https://via.placeholder.com/300x450?text=No+Image"
ZERO_RATING = "0.0"
VALID_CATEGORIES = ("want_watch", "watched", "liked")
DEFAULT_CATEGORY = "liked"
MIN_SELECTION = 10  # movies a user must pick before recommending
PAGE_SIZE = 24  # catalog page
SAMPLE_SIZE = 200  # random movie sample
BATCH_SIZE = 30  # movies per selection batch
HOME_TOP = 8  # recommendations on the home page
TOP_N = 10  # recommendations per user
# -----------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """Not NULL, not NaN, not +-infinity."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_positive_prediction(c: str | Column) -> Column:
    """``prediction > 0`` with Scala semantics: NaN is not positive."""
    x = col(c)
    return is_finite(x) & (x > 0)


def js_falsy_number(c: str | Column) -> Column:
    """JavaScript falsiness of a numeric column: NULL, 0 or NaN."""
    x = col(c)
    return x.isNull() | (x == 0) | F.isnan(x.cast("double"))


def js_parse_int(c: str | Column) -> Column:
    """``parseInt(x)``: leading optional sign and digits after leading blanks;
    NULL when there is no such prefix (JavaScript's NaN)."""
    digits = F.regexp_extract(F.ltrim(col(c).cast("string")), r"^([+-]?\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def js_to_number(c: str | Column) -> Column:
    """``Number(x)`` for a JSON scalar read as text: blank is 0, junk is NULL."""
    s = F.trim(col(c).cast("string"))
    plain = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")  # a Java cast would also take "4d"
    return F.when(s == "", F.lit(0.0)).when(plain, s.try_cast("double"))


def to_fixed_1(c: str | Column) -> Column:
    """``x ? x.toFixed(1) : '0.0'`` for values that already have one decimal."""
    x = col(c)
    return F.when(js_falsy_number(x), F.lit(ZERO_RATING)).otherwise(F.format_string("%.1f", x.cast("double")))


def mean_to_fixed_1(c: str | Column) -> Column:
    """``x.toFixed(1)`` of any non-negative double, ``'0.0'`` for NULL: the nearest decimal of the exact
    binary value; an exact tie (x.25, x.75) goes up, where ``format_number`` would go to the even digit."""
    x = col(c).cast("double")
    tie = (x * 4) % 2 == 1
    up = F.when(tie, (F.floor(x * 10) + 1) / 10).otherwise(x)
    return F.coalesce(F.call_function("format_number", up, F.lit("0.0")), F.lit(ZERO_RATING))


def or_default(c: str | Column, default: str) -> Column:
    """``x || default`` for strings: NULL and '' fall back."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def votes(c: str | Column) -> Column:
    """``numrating || 0``."""
    x = col(c)
    return F.when(js_falsy_number(x), F.lit(0)).otherwise(x).cast("int")


def release_year(c: str | Column) -> Column:
    """Year of a date, or the fixed ``未知``."""
    return F.coalesce(F.year(col(c)).cast("string"), F.lit(UNKNOWN))


def poster(c: str | Column) -> Column:
    return or_default(c, NO_POSTER)


def genre_list(c: str | Column, n: int | None = None, trim: bool = True) -> Column:
    """Comma list -> array; NULL or '' -> empty array; first ``n`` when given."""
    parts = F.split(col(c), ",")
    if trim:
        parts = F.transform(parts, lambda g: F.trim(g))
    if n is not None:
        parts = F.slice(parts, 1, n)
    return F.when(col(c).isNull() | (col(c) == ""), F.array().cast("array<string>")).otherwise(parts)


def genre_text(c: str | Column, n: int | None = None, sep: str = "|") -> Column:
    """``genre_list`` rendered as one string (for flat exports and comparisons)."""
    return F.array_join(genre_list(c, n), sep)


def epoch_seconds(c: str | Column) -> Column:
    """Seconds since the epoch of a timestamp (session time zone must be UTC)."""
    return F.unix_seconds(col(c).cast("timestamp"))


def epoch_micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def valid_category(c: str | Column) -> Column:
    """Requested category with the default applied (``req.body.category || 'liked'``)."""
    return or_default(c, DEFAULT_CATEGORY)


def is_valid_category(c: str | Column) -> Column:
    return valid_category(c).isin(*VALID_CATEGORIES)


def stable_sample_key(seed: str | int, c: str | Column) -> Column:
    """Reproducible stand-in for ``ORDER BY RAND()``: md5 of seed and id."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), col(c).cast("string")))
