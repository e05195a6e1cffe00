"""A stored order: rows kept in a total order, so that a page or a user's positions read only
the files that hold them.

A ranked table is a folder with

* ``rows/part=<p>/``: the rows of range partition p with ``__local``, their place in it;
* ``slices/``: a row per (group, part) with the group's first place in that part, its
  number of rows there and in the parts before (at most groups + parts rows);
* ``parts/``: a row per part with the rank of its first row; written last, so a table whose
  write broke off can't be opened.

The range partitioner splits a hot group over many parts.  Numbering happens once, as the
table is written; after that ranks and positions come from joins with the small tables
above, without a shuffle of the rows, a window or a checkpoint.

``order_by`` must be total (end it with a unique key): equal rows get an arbitrary but fixed
order.  Null groups are a group.  An empty table has no parts, and every page of it is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.joins import fits_broadcast

PART, LOCAL = "part", "__local"


def write_ranked(df: DataFrame, path: str, order_by: Sequence[Column], groups: Sequence[str] = (),
                 num_partitions: int | None = None) -> "RankedTable":
    """Store ``df`` (no column may be called ``part`` or ``__local``) in the order ``groups``,
    then ``order_by``."""
    spark, groups = df.sparkSession, list(groups)
    order = [F.col(g).asc() for g in groups] + list(order_by)
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    # sorted by part first, which a task's rows share, so the writer sorts no more
    placed = ranged.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order).withColumn(
        LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed.write.partitionBy(PART).parquet(f"{path}/rows")
    rows = _rows(spark, path, df.schema)
    if groups:
        here = rows.groupBy(*groups, PART).agg(F.min(LOCAL).alias("first_local"), F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        here.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).write.parquet(f"{path}/slices")
    # a row per part: bounded by the number of range partitions
    sizes = sorted((r[PART], r["n"]) for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect())
    first, parts = 1, []
    for part, n in sizes:
        parts.append((part, first, n))
        first += n
    spark.createDataFrame(parts, "part int, first_rank long, n long").coalesce(1).write.parquet(f"{path}/parts")
    return RankedTable(spark, path, df.schema, groups, parts)


def open_ranked(spark: SparkSession, path: str, schema: StructType, groups: Sequence[str] = ()) -> "RankedTable":
    """A table that was written before; ``schema`` is that of its rows."""
    parts = [tuple(r) for r in spark.read.schema("part int, first_rank long, n long").parquet(f"{path}/parts").collect()]
    return RankedTable(spark, path, schema, list(groups), sorted(parts))


def _rows(spark: SparkSession, path: str, schema: StructType, parts: Sequence[int] | None = None) -> DataFrame:
    """The rows of some parts (all by default); other parts' files are not listed."""
    full = StructType([*schema.fields, StructField(LOCAL, LongType()), StructField(PART, IntegerType())])
    reader = spark.read.schema(full).option("basePath", f"{path}/rows")
    if parts is None:
        return reader.parquet(f"{path}/rows")
    return reader.parquet(*[f"{path}/rows/{PART}={p}" for p in parts]) if parts else spark.createDataFrame([], full)


@dataclass
class RankedTable:
    spark: SparkSession
    path: str
    schema: StructType
    groups: list[str]
    parts: list[tuple[int, int, int]]      # part, rank of its first row, rows

    @property
    def total(self) -> int:
        return self.parts[-1][1] + self.parts[-1][2] - 1 if self.parts else 0

    def ranked(self, rank_col: str = "rank") -> DataFrame:
        """All rows with their 1-based rank."""
        firsts = self.spark.createDataFrame([p[:2] for p in self.parts], f"{PART} int, __first long")
        rows = _rows(self.spark, self.path, self.schema, None if self.parts else [])
        ranked = rows.join(F.broadcast(firsts), PART)  # a row per part
        return ranked.withColumn(rank_col, F.col("__first") + F.col(LOCAL)).select(*self.schema.names, rank_col)

    def between(self, low: int, high: int, rank_col: str = "rank") -> DataFrame:
        """The rows of ranks ``low`` to ``high``, from the parts that hold them."""
        held = [(p, first) for p, first, n in self.parts if first <= high and first + n > low]
        rows = _rows(self.spark, self.path, self.schema, [p for p, _ in held])
        if held:  # places, not ranks, so that the filter reaches the files' row groups
            rows = rows.where(reduce(or_, [(F.col(PART) == p) & F.col(LOCAL).between(low - first, high - first) for p, first in held]))
        first = F.create_map(*[F.lit(x) for pair in held for x in pair])[F.col(PART)] if held else F.lit(0)
        return rows.withColumn(rank_col, (first + F.col(LOCAL)).cast("long")).select(*self.schema.names, rank_col)

    def page(self, number: int, size: int, rank_col: str = "rank") -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows."""
        return self.between((number - 1) * size + 1, number * size, rank_col)

    def _slices(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/slices")

    def _positions(self, rows: DataFrame, slices: DataFrame, out_col: str) -> DataFrame:
        on = [*self.groups, PART]
        slices = slices.select(*[F.col(c).alias(f"__s_{i}") for i, c in enumerate(on)], "first_local", "before")
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(slices[f"__s_{i}"]) for i, c in enumerate(on)])
        joined = rows.join(F.broadcast(slices) if fits_broadcast(slices) else slices, same)
        place = F.col("before") + F.col(LOCAL) - F.col("first_local") + 1
        return joined.withColumn(out_col, place).select(*self.schema.names, out_col)

    def positions(self, out_col: str = "rank") -> DataFrame:
        """All rows with their 1-based position in their group."""
        rows = _rows(self.spark, self.path, self.schema, None if self.parts else [])
        return self._positions(rows, self._slices(), out_col)

    def positions_of(self, keys: DataFrame, low: int, high: int, out_col: str = "rank") -> DataFrame:
        """Positions ``low`` to ``high`` of the groups in ``keys``: only the parts that hold
        them are read.  The list of those parts, bounded by their number, is collected."""
        wanted = keys.select(*[F.col(g).alias(f"__k_{i}") for i, g in enumerate(self.groups)]).distinct()
        slices = self._slices().where((F.col("before") < high) & (F.col("before") + F.col("n") >= low))
        same = reduce(lambda a, b: a & b, [slices[g].eqNullSafe(wanted[f"__k_{i}"]) for i, g in enumerate(self.groups)])
        slices = slices.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, same, "left_semi")
        held = sorted(r[0] for r in slices.select(PART).distinct().collect())
        found = self._positions(_rows(self.spark, self.path, self.schema, held), slices, out_col)
        return found.where(F.col(out_col).between(low, high))
