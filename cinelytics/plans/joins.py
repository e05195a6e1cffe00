"""Joins against a dimension-like side.

``join_dimension`` is the one place where this library decides between a
broadcast and a shuffle join: the small side's rows and bytes are added up first
(per-task sums, then their sum) and it is broadcast only within both bounds.  Above
a bound the join is a plain shuffle join on the keys, and AQE's skew join
splits the partitions of hot keys on the fact side at run time; the dimension
is never replicated as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

from ..session import BROADCAST_MAX_BYTES_KEY, BROADCAST_MAX_ROWS_KEY, conf_int

DEFAULT_BROADCAST_MAX_ROWS = 2_000_000
DEFAULT_BROADCAST_MAX_BYTES = 128 << 20


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def fits_broadcast(dim: DataFrame, max_rows: int | None = None, known_rows: int | None = None,
                   max_bytes: int | None = None) -> bool:
    """True when ``dim`` is within the row and the byte bound: one aggregate counts
    its rows and adds up its variable-width values (``known_rows``: a count the
    caller has, which spares the pass when every column has a fixed width)."""
    spark = dim.sparkSession
    bound = max_rows if max_rows is not None else conf_int(spark, BROADCAST_MAX_ROWS_KEY, DEFAULT_BROADCAST_MAX_ROWS)
    max_bytes = max_bytes or conf_int(spark, BROADCAST_MAX_BYTES_KEY, DEFAULT_BROADCAST_MAX_BYTES)
    if bound <= 0 or (known_rows is not None and known_rows > bound):
        return False
    varying = [f for f in dim.schema.fields if not isinstance(f.dataType, (NumericType, DatetimeType, BooleanType))]
    rows, width = known_rows, 0
    if varying or rows is None:
        # one row per task and their sum; a text counts its bytes, any other value those of its text form
        size = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in varying]
        rows, width = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(size, F.lit(0))), F.lit(0))).first()
    return rows <= bound and width + rows * 8 * len(dim.columns) <= max_bytes


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    dim_rows: int | None = None,
) -> DataFrame:
    """Join a (possibly skewed) fact side to a dimension side on equal keys.

    ``how`` is one of inner / left / left_semi / left_anti (fact side preserved).
    ``dim_rows``: exact row count of ``dim`` when the caller knows it.
    """
    keys = _keys(on)
    if fits_broadcast(dim, max_rows, dim_rows):
        return fact.join(F.broadcast(dim), keys, how)
    return fact.join(dim, keys, how)


def join_in_place(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that are stored in the same buckets of ``on``: a merge of the buckets,
    whatever the size of ``dim``; without buckets, a shuffle join under AQE's skew join."""
    return fact.join(dim.hint("merge"), _keys(on), how)


def is_in_dimension(fact: DataFrame, dim_keys: DataFrame, on: str | Sequence[str], flag: str,
                    max_rows: int | None = None) -> DataFrame:
    """Add a boolean ``flag``: does the fact row's key exist in ``dim_keys``."""
    keys = _keys(on)
    marked = dim_keys.select(*keys).distinct().withColumn(flag, F.lit(True))
    out = join_dimension(fact, marked, keys, "left", max_rows=max_rows)
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))

