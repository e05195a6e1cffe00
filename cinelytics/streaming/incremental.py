"""Aggregates kept up to date by signed deltas, without reading their input again.

A view holds additive numbers per key (row counts, sums, histogram counts).  When rows
of the base table are replaced or deleted, its delta is what the old rows added, with a
minus sign, plus what the new rows add; the old rows are those of the touched keys, read from
their buckets alone.  Deltas are summed per view key before they meet the view, and the
view's touched keys are replaced; a key without rows leaves the view.

Base table and views are keyed tables of ``sources.tables`` with a commit each.  A batch is
one unit all the same: its deltas are stored first, then the base table takes the batch,
then the views take the stored deltas, each only once (``batch=``).  Whatever step a
replay starts after, it finds the deltas of the rows as they were before the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import columns as C
from ..sources import tables as tb

ROWS = "n_rows"


@dataclass(frozen=True)
class SignedView:
    """``path`` holds, per ``key``, the row count and the sum of each of ``sums`` (whole
    numbers, so that adding and taking away is exact; null counts as nothing)."""

    path: str
    key: tuple[str, ...]
    sums: dict[str, Callable[[], Column]] = field(hash=False)

    def of(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        one = F.lit(sign).cast("long")
        return rows.select(*self.key, one.alias(ROWS), *[
            (F.coalesce(make().cast("long"), F.lit(0)) * sign).alias(name) for name, make in self.sums.items()])

    def total(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.key).agg(*[F.sum(c).alias(c) for c in (ROWS, *self.sums)])

    def schema(self, base: StructType) -> StructType:
        out = StructType([base[k] for k in self.key])
        for c in (ROWS, *self.sums):
            out = out.add(c, LongType())
        return out

    def create(self, rows: DataFrame, buckets: int | None = None) -> None:
        """The view of a whole table: the one time that it is read."""
        tb.create_keyed_table(self.total(self.of(rows)), self.path, self.key, buckets)

    def apply(self, spark: SparkSession, deltas: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add deltas (one row per key) to the view."""
        held = tb.read_rows_for_keys(spark, self.path, deltas, self.key)
        now = self.total(held.unionByName(deltas)).where(F.col(ROWS) != 0)
        tb.replace_by_key(spark, self.path, now, self.key, replaced=deltas, batch=batch)
        tb.vacuum(spark, self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return tb.read_keyed_table(spark, self.path)


def rating_stats_view(path: str) -> SignedView:
    """Counts, sum and 1..5 histogram of every user's ratings."""
    sums = {"n_rated": lambda: F.col("rating").isNotNull(), "sum_rating": lambda: F.col("rating")}

    def equals(k):
        return lambda: F.col("rating") == k

    return SignedView(path, ("userid",), sums | {f"n_{k}": equals(k) for k in range(1, 6)})


def rating_stats(view: SignedView, spark: SparkSession) -> DataFrame:
    """The columns of ``operators.ratings.rating_stats``, for users that have a rating."""
    return view.read(spark).select(
        "userid", F.col(ROWS).alias("total_ratings"), F.try_divide("sum_rating", "n_rated").alias("avg_rating"),
        *[f"n_{k}" for k in range(1, 6)]).withColumn("avg_text", C.mean_to_fixed_1("avg_rating"))


def favorites_count_view(path: str) -> SignedView:
    """Favourites per user and category."""
    def equals(c):
        return lambda: F.col("category") == c

    return SignedView(path, ("userid",), {c: equals(c) for c in C.VALID_CATEGORIES})


def favorites_count(view: SignedView, spark: SparkSession) -> DataFrame:
    return view.read(spark).select("userid", *C.VALID_CATEGORIES, F.col(ROWS).alias("total"))


def recommendations_count_view(path: str) -> SignedView:
    """Stored recommendations per user."""
    return SignedView(path, ("userid",), {})


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = tb._fs(spark, path)
    return fs.exists(hadoop_path(path))


def replace_with_views(spark: SparkSession, path: str, new_rows: DataFrame, key: str | Sequence[str],
                       views: Sequence[SignedView], replaced: DataFrame | None = None,
                       batch: tuple[str, int] | None = None) -> None:
    """``tables.replace_by_key`` on ``path`` that keeps ``views`` equal to their aggregates.

    ``new_rows`` and ``replaced`` are read several times: pass checkpointed frames.  Without
    a ``batch`` the operation gets the next number of a stream of its own, and a failed
    one must be run again before the next."""
    names = [key] if isinstance(key, str) else list(key)
    if batch is None:
        commit = tb._need(spark, path)
        batch = ("direct", commit["batches"].get("direct", -1) + 1)
    keys = new_rows.select(*names)
    keys = keys if replaced is None else keys.unionByName(replaced.select(*names))
    folders = [f"{path}/deltas/{i}/{batch[0]}-{batch[1]}" for i in range(len(views))]
    open_views = [(v, f) for v, f in zip(views, folders) if not tb._done(tb.read_commit(spark, v.path), batch)]
    for view, folder in open_views:
        if not _exists(spark, f"{folder}/_SUCCESS"):
            old = tb.read_rows_for_keys(spark, path, keys, names)
            base = StructType.fromJson(tb.read_commit(spark, path)["schema"])
            new = new_rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.fields])
            deltas = view.total(view.of(old, -1).unionByName(view.of(new)))
            busy = [F.col(c) != 0 for c in (ROWS, *view.sums)]
            changed = busy[0]
            for b in busy[1:]:
                changed |= b
            deltas.where(changed).write.mode("overwrite").parquet(folder)
    tb.replace_by_key(spark, path, new_rows, key, replaced, batch)
    hadoop_path, fs = tb._fs(spark, path)
    base = StructType.fromJson(tb.read_commit(spark, path)["schema"])
    for view, folder in open_views:
        view.apply(spark, spark.read.schema(view.schema(base)).parquet(folder), batch)
    for folder in folders:
        fs.delete(hadoop_path(folder), True)
    tb.vacuum(spark, path)
