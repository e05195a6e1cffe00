"""JDBC tables (the original's MySQL tables).

Reads are partitioned on a numeric column when bounds are given, so a large
table is not pulled through one connection; filters and projections on the
returned frame are pushed into the database query by Spark.  Writes append in
parallel batches.  These need a reachable database, so they are not part of
the registered queries (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    props = dict(properties or {})
    if partition_column is not None:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partitioned JDBC read needs lower_bound, upper_bound and num_partitions")
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                               upperBound=upper_bound, numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, mode: str = "append",
               batch_size: int = 10_000) -> None:
    props = dict(properties or {})
    props.setdefault("batchsize", str(batch_size))
    df.write.jdbc(url, table, mode=mode, properties=props)
