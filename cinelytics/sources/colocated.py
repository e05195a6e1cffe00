"""Tables stored together by one key, so that work per key needs no exchange.

``write_colocated`` keeps several tables in one folder:

* ``cold/<name>/``: the rows of ordinary keys, in the same number of buckets of the key for
  every table.  They are read as bucketed scans: an aggregate by the key or a join on it
  runs where the buckets lie;
* ``hot/<name>/``: the rows of hot keys, in no buckets.  A key is hot for all tables once one
  of them holds more than ``rows_per_bucket`` rows of it, so no bucket, which one task
  reads, grows with a key.  Work on them is planned as on any table (partial aggregates,
  AQE's skew join);
* ``layout/``: name, schema, key and buckets of each table; written last, so a folder whose
  write broke off can't be opened.

``per_key`` runs a function on the cold and on the hot tables and appends the results: for a
function whose output rows depend on the rows of one key only (joins on it, groupings that
hold it) that is the function of the whole tables.  Null is a key like any other in storage
(joins still never match it).  Empty tables have no files, and their schema.

Spark knows buckets by its session catalog only, so each table gets an entry there (an external
table of a unique name); another session gets its own from ``open_colocated``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.joins import fits_broadcast

ROWS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 8
_LAYOUT = "name string, fields string, key string, buckets int, hot boolean"


def write_colocated(tables: dict[str, DataFrame], key: str, path: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                    min_buckets: int = MIN_BUCKETS) -> "Colocated":
    """Store ``tables``, which all have the column ``key`` of one type."""
    if len({df.schema[key].dataType for df in tables.values()}) > 1:
        raise ValueError(f"the tables hold {key} in different types, whose buckets differ")
    spark = next(iter(tables.values())).sparkSession
    per_key = {name: df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")) for name, df in tables.items()}
    large = F.col("__n") > rows_per_bucket
    sizes = {name: n.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(large)).first() for name, n in per_key.items()}
    buckets = max(min_buckets, -(-max(rows for rows, _ in sizes.values()) // rows_per_bucket))
    hot = None
    if any(n for _, n in sizes.values()):
        found = [per_key[name].where(large).select("__key") for name, (_, n) in sizes.items() if n]
        reduce(DataFrame.union, found).distinct().write.parquet(f"{path}/hot_keys")
        hot = spark.read.parquet(f"{path}/hot_keys")  # at most the rows over rows_per_bucket, for each table
        hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    for name, df in tables.items():
        cold = df
        if hot is not None:
            same = df[key].eqNullSafe(hot["__key"])
            df.join(hot, same, "left_semi").write.parquet(f"{path}/hot/{name}")
            cold = df.join(hot, same, "left_anti")
        # the shuffle's hash is the buckets' hash, so each task writes one file of one bucket
        (cold.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{path}/cold/{name}")
         .format("parquet").saveAsTable(_fresh_name(name)))
    layout = [(name, df.schema.json(), key, buckets, hot is not None) for name, df in tables.items()]
    spark.createDataFrame(layout, _LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    return open_colocated(spark, path)


def open_colocated(spark: SparkSession, path: str) -> "Colocated":
    """Tables that were written before, by this or another session."""
    entries, schemas, key, hot = {}, {}, None, False
    for r in spark.read.schema(_LAYOUT).parquet(f"{path}/layout").collect():  # a row per table
        schema, key, hot, entries[r["name"]] = StructType.fromJson(json.loads(r["fields"])), r["key"], r["hot"], _fresh_name(r["name"])
        schemas[r["name"]] = schema
        place = f"{path}/cold/{r['name']}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {entries[r['name']]} ({schema.toDDL()}) USING parquet "
                  f"CLUSTERED BY ({_quoted(key)}) INTO {r['buckets']} BUCKETS LOCATION '{place}'")
    return Colocated(spark, path, key, entries, schemas, hot)


def _fresh_name(name: str) -> str:
    return _quoted(f"cinelytics_{name}_{uuid.uuid4().hex[:12]}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Colocated:
    spark: SparkSession
    path: str
    key: str
    entries: dict[str, str]            # table -> its name in the session catalog
    schemas: dict[str, StructType]
    has_hot: bool

    def cold(self) -> dict[str, DataFrame]:
        return {name: self.spark.table(entry) for name, entry in self.entries.items()}

    def hot(self) -> dict[str, DataFrame]:
        """The rows of hot keys; tables without rows if there is none."""
        if not self.has_hot:
            return {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/hot/{name}") for name, schema in self.schemas.items()}

    def per_key(self, work: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """``work`` of the whole tables, in place for all but the hot keys."""
        out = work(self.cold())
        return out.unionByName(work(self.hot())) if self.has_hot else out
