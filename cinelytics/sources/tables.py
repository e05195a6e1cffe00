"""Keyed tables on files: append, replace by key and delete, each one atomic commit.

A table is a folder with

* ``data/<version>-<id>/<part>/key_bucket=<b>/``: Parquet files, written once, never changed;
* ``commits/<version>.json``: schema, key, number of buckets, the folders that make up each
  bucket and the last batch of every stream that wrote to it.

Readers take the newest commit and read exactly its folders with its schema, so an
empty table has a schema, a reader keeps the rows of the version it opened, and
a job that dies between its write and its commit changes nothing.  A commit is written
beside its place and renamed into it, which fails if another writer was first
(``CommitConflict``: run the operation again on the newer version).

* append (``INSERT``)                 -> ``append_rows``: new folders, no old row is read
* delete a user's rows, then insert   -> ``replace_by_key``: new rows are written once; of the
  buckets they hash to, the rows of other keys are written beside them
* delete rows of a user set           -> ``replace_by_key`` with no new rows; ``delete_by_key`` on frames
* ``REPLACE INTO`` on a key           -> ``replace_by_key`` with one row a key, ``status.progress_upsert``

An operation with ``batch=(stream, number)`` is a no-op where the commit says that this
batch, or a later one, of the stream is in: a replayed micro-batch changes nothing.  A bucket of more than
``MAX_FOLDERS`` folders is merged by the next append to it.  ``vacuum`` removes what the last
commits don't use.  A null key is a key like any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET_COL = "key_bucket"
ROWS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 16
MAX_FOLDERS = 8


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bucket_of(key: str | Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in _keys(key)]), F.lit(buckets)).cast("int")


# ------------------------------------------------------------------ commits --

def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop_path, hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    hadoop_path, fs = _fs(spark, path)
    if not fs.exists(hadoop_path(path)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path(path)))


def table_versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:-5]) for name in _names(spark, f"{path}/commits") if name.endswith(".json") and name[0] != "."]


def read_commit(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest commit (or that of ``version``); None where there is no table."""
    versions = table_versions(spark, path)
    if not versions:
        return None
    hadoop_path, fs = _fs(spark, path)
    stream = fs.open(hadoop_path(f"{path}/commits/{version or versions[-1]:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, commit: dict) -> None:
    """Swap in a commit: written under another name, then renamed, never over an existing one."""
    hadoop_path, fs = _fs(spark, path)
    final = hadoop_path(f"{path}/commits/{commit['version']:012d}.json")
    draft = hadoop_path(f"{path}/commits/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(json.dumps(commit).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 0)
    try:
        context.rename(draft, final, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise CommitConflict(f"version {commit['version']} of {path} exists") from e
        raise


def _next(commit: dict | None) -> tuple[int, str]:
    version = (commit["version"] if commit else 0) + 1
    return version, f"data/{version:012d}-{uuid.uuid4().hex[:8]}"


def _done(commit: dict | None, batch: tuple[str, int] | None) -> bool:
    return bool(commit and batch and commit["batches"].get(batch[0], -1) >= batch[1])


def _write(df: DataFrame, path: str, folder: str, key, buckets: int) -> dict[str, str]:
    """Write rows by bucket; the folder of each bucket that got rows.  ``rebalance`` lets AQE
    split an oversized bucket over several tasks."""
    (df.withColumn(BUCKET_COL, bucket_of(key, buckets)).hint("rebalance", BUCKET_COL)
       .write.partitionBy(BUCKET_COL).parquet(f"{path}/{folder}"))
    return {name.split("=")[1]: f"{folder}/{name}" for name in _names(df.sparkSession, f"{path}/{folder}")
            if name.startswith(f"{BUCKET_COL}=")}


def _read(spark: SparkSession, path: str, commit: dict, buckets=None) -> DataFrame:
    schema = StructType.fromJson(commit["schema"])
    folders = [f for b, fs in commit["folders"].items() if buckets is None or int(b) in buckets for f in fs]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def _need(spark: SparkSession, path: str) -> dict:
    commit = read_commit(spark, path)
    if commit is None:
        raise FileNotFoundError(f"no keyed table at {path}")
    return commit


def _nullable(schema: StructType) -> StructType:
    return StructType.fromJson(json.loads(schema.json().replace('"nullable":false', '"nullable":true')))


# --------------------------------------------------------------- operations --

def create_keyed_table(df: DataFrame, path: str, key: str | Sequence[str], buckets: int | None = None) -> None:
    """Write a keyed table, or replace all of one; its number of buckets follows the number
    of rows (one counting pass)."""
    spark = df.sparkSession
    buckets = buckets or max(MIN_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
    version, folder = _next(read_commit(spark, path))
    found = _write(df, path, f"{folder}/new", key, buckets)
    _commit(spark, path, {
        "version": version, "schema": json.loads(_nullable(df.schema).json()), "key": _keys(key), "buckets": buckets,
        "folders": {b: [f] for b, f in found.items()}, "batches": {}})


def ensure_keyed_table(spark: SparkSession, path: str, schema: StructType, key: str | Sequence[str],
                       buckets: int = MIN_BUCKETS) -> None:
    """An empty table where there is none."""
    if read_commit(spark, path) is None:
        create_keyed_table(spark.createDataFrame([], schema), path, key, buckets)


def append_rows(df: DataFrame, path: str, key: str | Sequence[str], batch: tuple[str, int] | None = None) -> None:
    """Append to a keyed table.  No old row is read, but for buckets of many small appends."""
    spark = df.sparkSession
    commit = _need(spark, path)
    if _done(commit, batch):
        return
    version, folder = _next(commit)
    schema = StructType.fromJson(commit["schema"])
    found = _write(df.select(*schema.names), path, f"{folder}/new", key, commit["buckets"])
    folders = {b: [*fs] for b, fs in commit["folders"].items()}
    for b, f in found.items():
        folders.setdefault(b, []).append(f)
    crowded = {int(b) for b in found if len(folders[b]) > MAX_FOLDERS}
    if crowded:
        merged = _write(_read(spark, path, {**commit, "folders": folders}, crowded), path, f"{folder}/merged", key, commit["buckets"])
        folders |= {b: [f] for b, f in merged.items()}
    _commit(spark, path, _following(commit, version, folders, batch))


def _following(commit: dict, version: int, folders: dict, batch) -> dict:
    batches = commit["batches"] | ({batch[0]: batch[1]} if batch else {})
    return {**commit, "version": version, "folders": {b: fs for b, fs in folders.items() if fs}, "batches": batches}


def read_keyed_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest (or a kept older) version."""
    _need(spark, path)
    return _read(spark, path, read_commit(spark, path, version))


def _same_key(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]):
    out = F.lit(True)
    for k, r in zip(keys, names):
        out &= left[k].eqNullSafe(right[r])
    return out


def _semi(rows: DataFrame, keys_df: DataFrame, keys: list[str], how: str) -> DataFrame:
    names = [f"__key_{i}" for i in range(len(keys))]
    wanted = keys_df.select(*[F.col(k).alias(x) for k, x in zip(keys, names)]).distinct()
    return rows.join(wanted, _same_key(rows, wanted, keys, names), how)


def _buckets_of(keys_df: DataFrame, keys: list[str], buckets: int) -> set[int]:
    """At most ``buckets`` numbers."""
    return {r[0] for r in keys_df.select(bucket_of(keys, buckets).alias("b")).distinct().collect()}


def read_rows_for_keys(spark: SparkSession, path: str, keys_df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of a keyed table whose key is in ``keys_df``, reading only the bucket folders
    those keys hash to (the file-table form of ``SELECT ... WHERE userid = ?`` on the
    original tables); the semi join then keeps the exact keys."""
    k, commit = _keys(key), _need(spark, path)
    keys_df = keys_df.select(*[F.col(x).cast(StructType.fromJson(commit["schema"])[x].dataType).alias(x) for x in k])
    return _semi(_read(spark, path, commit, _buckets_of(keys_df, k, commit["buckets"])), keys_df, k, "left_semi")


def delete_by_key(df: DataFrame, keys_df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys_df``."""
    k = _keys(key)
    return df.join(keys_df.select(*k).distinct(), k, "left_anti").select(*df.columns)


def replace_by_key(spark: SparkSession, path: str, new_rows: DataFrame, key: str | Sequence[str],
                   replaced: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
    """Every key present in ``new_rows`` (and in ``replaced``, whose keys may get no row at
    all) loses all its old rows and gets the new ones; other keys are untouched, and a
    second run with the same rows changes no row.  Every new row is written once, every
    other row of a touched bucket once, and one commit makes all of it visible."""
    k, commit = _keys(key), _need(spark, path)
    if _done(commit, batch):
        return
    version, folder = _next(commit)
    schema, buckets = StructType.fromJson(commit["schema"]), commit["buckets"]
    typed = {f.name: F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields}
    found = _write(new_rows.select(*typed.values()), path, f"{folder}/new", k, buckets)
    written = _read(spark, path, {**commit, "folders": {b: [f] for b, f in found.items()}})
    gone, touched = written.select(*k), {int(b) for b in found}
    if replaced is not None:
        more = replaced.select(*[typed[x] for x in k])
        gone, touched = gone.union(more), touched | _buckets_of(more, k, buckets)
    held = {b for b in touched if commit["folders"].get(str(b))}
    kept = {}
    if held:
        kept = _write(_semi(_read(spark, path, commit, held), gone, k, "left_anti"), path, f"{folder}/kept", k, buckets)
    folders = {b: fs for b, fs in commit["folders"].items() if int(b) not in touched}
    for b in map(str, sorted(touched)):
        folders[b] = [x[b] for x in (kept, found) if b in x]
    _commit(spark, path, _following(commit, version, folders, batch))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove the commits before the last ``keep`` and every data folder that none of those
    uses.  Readers of older versions, and writers at work, need their folders: call it from
    the one writer, and keep as many versions as readers may be behind."""
    hadoop_path, fs = _fs(spark, path)
    versions = table_versions(spark, path)
    kept = versions[-keep:]
    used = {f for v in kept for fs_ in read_commit(spark, path, v)["folders"].values() for f in fs_}
    for v in versions[:-keep]:
        fs.delete(hadoop_path(f"{path}/commits/{v:012d}.json"), False)
    for name in _names(spark, f"{path}/data"):
        for part in _names(spark, f"{path}/data/{name}"):
            mine = f"data/{name}/{part}/"
            live = {f for f in used if f.startswith(mine)}
            for bucket in _names(spark, f"{path}/{mine}") if live else []:
                if bucket.startswith(f"{BUCKET_COL}=") and mine + bucket not in live:
                    fs.delete(hadoop_path(f"{path}/{mine}{bucket}"), True)
            if not live:
                fs.delete(hadoop_path(f"{path}/{mine}"), True)
        if not _names(spark, f"{path}/data/{name}"):
            fs.delete(hadoop_path(f"{path}/data/{name}"), True)


def query_view(spark: SparkSession, df: DataFrame, view: str, sql: str, args: dict | None = None) -> DataFrame:
    """Register ``df`` as a temp view and run parameterised SQL on it (values
    are bound with ``args``, never concatenated into the text)."""
    df.createOrReplaceTempView(view)
    return spark.sql(sql, args=args or {})
