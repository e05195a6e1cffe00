"""Small helpers shared by the operators of this subpackage.

Every operator reads only the columns it is told to read (an id and a text
column by default); extra columns never take part, whatever their names are.
Python work runs inside ``mapInArrow`` over a few rows at a time, so a task
holds one Arrow batch and the working set of ``SLICE_CHARS`` characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

SLICE_ROWS = 512
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read the table back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side whose measured size is at most this may be sent to every task.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, row_bytes) -> DataFrame:
    """``df``, marked for a broadcast join if the sum of ``row_bytes`` (an estimate per row,
    with the JVM's overhead) is proven to be at most BROADCAST_BYTES; else unmarked, so
    that the join shuffles."""
    total = df.agg(F.sum(row_bytes).cast("long")).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


_KEPT: dict = {}
_STAGE: list = [None]


def enter_stage() -> None:
    """Called as a task's Python work begins.  Spark uses its Python workers again, so what
    the tasks of an earlier stage kept in this one goes, and memory that is free goes back
    to the system: otherwise a stage pays for every stage before it."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage == _STAGE[0]:
        return
    _STAGE[0] = stage
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # glibc; elsewhere its allocator decides
    except (OSError, AttributeError):
        pass


def kept(key, make: Callable):
    """``make()``, kept in this Python worker for the tasks of one stage; one value at a time."""
    enter_stage()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    used = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in used:
        name = f"_{name}"
    return name


def text_slices(texts: pa.Array, slice_rows: int = SLICE_ROWS, slice_chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) pieces of a string column: whole texts, null as empty,
    at most ``slice_rows`` rows and about ``slice_chars`` characters (or one long text)."""
    rows, chars, start = [], 0, 0
    for i in range(len(texts)):
        t = texts[i].as_py() or ""
        if rows and (len(rows) >= slice_rows or chars + len(t) > slice_chars):
            yield start, rows
            rows, chars, start = [], 0, i
        rows.append(t)
        chars += len(t)
    if rows:
        yield start, rows


def map_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list]],
              fields: list[T.StructField], keep: list[str], extra: str | None = None,
              slice_rows: int = SLICE_ROWS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Append ``fields`` computed from whole texts to the columns ``keep``.

    ``make()`` runs once per task and returns ``f(texts) -> one list per field``;
    with ``extra``, ``f(texts, values of that column)``.
    A kept column that has the name of a result field is replaced by it."""
    names = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__t"),
                       *([F.col(f"`{extra}`").alias("__x")] if extra else []))
    n_keep = len(keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        enter_stage()
        work = make()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start, texts in text_slices(batch.column(n_keep), slice_rows, slice_chars):
                more = [batch.column(n_keep + 1).slice(start, len(texts)).to_pylist()] if extra else []
                made = work(texts, *more)
                cols = [batch.column(i).slice(start, len(texts)) for i in range(n_keep)]
                cols += [m if isinstance(m, pa.Array) else pa.array(m, arrow.field(n_keep + i).type)
                         for i, m in enumerate(made)]
                yield pa.RecordBatch.from_arrays(cols, names=list(arrow.names))

    return source.mapInArrow(run, schema)
