"""Distributed ordering helpers that never put one group into one task.

``global_rank`` numbers the rows of a frame 1..N in a total order without a
partition-less window (which would move every row into one task).  The frame is
range-partitioned and sorted within partitions (``range_tag``); each task
numbers its own rows; a table with one row per partition (bounded by the
partition count, so broadcasting it is safe) turns local numbers into global
ones (the sizes, one row per partition, are collected once).  The tagged frame
is checkpointed into the shared checkpoint folder, so every use of it sees the
same partitioning even if a task is recomputed.

``row_number_within`` and ``running_max_within`` build per-group orderings on
top of that: a range partitioner splits a hot group over many tasks, where a
``Window.partitionBy(group)`` would sort the whole group in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .joins import join_dimension


def range_tag(df: DataFrame, order_by: Sequence[Column], num_partitions: int | None = None,
              materialize: bool = True) -> DataFrame:
    """Range-partition + sort; add ``__pid`` (partition) and ``__local`` (0-based
    position inside the partition).  Without ``num_partitions`` AQE may merge
    adjacent (small) range partitions, which keeps the order, so a small input
    gets few tasks and a large one the full shuffle width."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(num_partitions, *order_by) if num_partitions else df.repartitionByRange(*order_by)
    tagged = (
        ranged
        .sortWithinPartitions(*order_by)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__local", F.monotonically_increasing_id() - F.shiftleft(F.col("__pid").cast("long"), 33))
    )
    if materialize:
        checkpoint_root(spark)
        tagged = tagged.checkpoint(eager=True)
    return tagged


def _partition_offsets(tagged: DataFrame) -> tuple[DataFrame, int]:
    """Rows before each partition, and the total.  The sizes are one row per
    partition (bounded by the partition count), so they are collected once and
    the offsets table is broadcast as a local relation."""
    sizes = sorted((r["__pid"], r["__n"]) for r in
                   tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n")).collect())
    rows, running = [], 0
    for pid, n in sizes:
        rows.append((pid, running))
        running += n
    offsets = tagged.sparkSession.createDataFrame(rows, "__pid int, __offset long")
    return offsets, running


def _with_global_rank(tagged: DataFrame, rank_col: str, offsets: DataFrame | None = None) -> DataFrame:
    if offsets is None:
        offsets, _ = _partition_offsets(tagged)
    ranked = tagged.join(F.broadcast(offsets), "__pid")
    return ranked.withColumn(rank_col, F.col("__offset") + F.col("__local") + 1).drop("__offset")


def global_rank(df: DataFrame, order_by: Sequence[Column], rank_col: str = "rank",
                num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in ``order_by`` order.
    ``order_by`` must be a total order (end it with a unique key)."""
    tagged = range_tag(df, order_by, num_partitions, materialize)
    return _with_global_rank(tagged, rank_col).drop("__pid", "__local")


def global_rank_with_count(df: DataFrame, order_by: Sequence[Column], rank_col: str = "rank",
                           num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``global_rank`` plus the exact row count, read from the per-partition
    sizes of the materialised frame (one small row per partition)."""
    tagged = range_tag(df, order_by, num_partitions, True)
    offsets, total = _partition_offsets(tagged)
    return _with_global_rank(tagged, rank_col, offsets).drop("__pid", "__local"), int(total)


def row_number_within(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[Column],
                      out_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY ...)`` for groups of any
    size: global rank minus the group's first global rank, plus one.  Rows that
    tie on every ordering column are numbered in an arbitrary but consistent way."""
    groups = list(group_cols)
    order = [F.col(g).asc() for g in groups] + list(order_by)
    ranked = _with_global_rank(range_tag(df, order, num_partitions), "__grank").drop("__pid", "__local")
    first = ranked.groupBy(*groups).agg(F.min("__grank").alias("__first"))  # one row per group
    out = join_dimension(ranked, first, groups)
    return out.withColumn(out_col, (F.col("__grank") - F.col("__first") + 1).cast("long")).drop("__grank", "__first")


def running_max_within(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[Column], value_col: str,
                       out_col: str, num_partitions: int | None = None) -> DataFrame:
    """Running ``max(value)`` over each group's rows up to the current one.

    Inside a range partition the running max is an ordinary window over the
    (group, partition) slice, which is bounded by the partition size; the max of
    all earlier slices of the same group (at most one per partition) is added
    from a small per-(group, partition) table."""
    groups = list(group_cols)
    order = [F.col(g).asc() for g in groups] + list(order_by)
    tagged = range_tag(df, order, num_partitions)
    slice_w = Window.partitionBy(*groups, "__pid").orderBy("__local").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("__run", F.max(value_col).over(slice_w))
    slice_max = tagged.groupBy(*groups, "__pid").agg(F.max(value_col).alias("__slice_max"))
    before = slice_max.select(
        *groups, "__pid",
        F.max("__slice_max").over(
            Window.partitionBy(*groups).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        ).alias("__before"),
    )
    out = join_dimension(local, before, groups + ["__pid"], "left")
    return out.withColumn(out_col, F.greatest(F.col("__run"), F.col("__before"))).drop(
        "__run", "__before", "__pid", "__local"
    )
