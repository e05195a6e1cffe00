"""Structured Streaming forms of the status and submission operators.

The pattern: a streaming aggregation keyed by the table's key runs in ``update``
mode; ``foreachBatch`` merges each micro-batch's changed rows into a keyed table of
``sources.tables`` (``replace_by_key`` with the batch number, so a replayed batch is a no-op) and drops
the files that no kept version uses.  The table is the stream's state as a
compacted snapshot: its size follows the keys, not the batches, and readers see whole
batches.  Checkpoints and tables go to the shared checkpoint folder.  Without a
watermark the key state is unbounded, as is the unique key of the original tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch_seconds
from ..operators.ratings import valid_submissions, well_formed
from ..session import scratch_path
from ..sources.tables import ensure_keyed_table, read_keyed_table, replace_by_key, vacuum
from .incremental import SignedView, replace_with_views


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str], stream: str, batch_id: int,
                views: Sequence[SignedView] = ()) -> None:
    """Merge a micro-batch (one row per key) into the keyed table at ``path``, created empty
    where there is none, and its signed views."""
    spark = batch.sparkSession
    ensure_keyed_table(spark, path, batch.schema, keys)
    for view in views:
        ensure_keyed_table(spark, view.path, view.schema(batch.schema), view.key)
    if views:
        replace_with_views(spark, path, batch.checkpoint(eager=True), keys, views, batch=(stream, batch_id))
    else:
        replace_by_key(spark, path, batch, keys, batch=(stream, batch_id))
        vacuum(spark, path)


def run_keyed_updates(agg: DataFrame, name: str, keys: Sequence[str], views: Sequence[SignedView] = (),
                      timeout_s: int | None = None) -> str:
    """Run an update-mode aggregation to completion (available-now trigger) and return the
    keyed table that holds its state."""
    spark = agg.sparkSession
    out = scratch_path(spark, f"{name}-state")
    ensure_keyed_table(spark, out, agg.schema, keys)
    for view in views:
        ensure_keyed_table(spark, view.path, view.schema(agg.schema), view.key)
    query = (agg.writeStream.outputMode("update")
             .foreachBatch(lambda batch, i: merge_batch(batch, out, keys, name, i, views))
             .option("checkpointLocation", scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True).start())
    _finish(query, name, timeout_s)
    return out


def _finish(query, name: str, timeout_s: int | None = None) -> None:
    """Wait for an available-now query (without a limit by default); a query still running at the timeout is
    stopped and reported, never returned as if complete."""
    finished = False
    try:
        if timeout_s is None:
            query.awaitTermination()
            finished = True
        else:
            finished = query.awaitTermination(timeout_s)
    finally:
        if query.isActive:
            query.stop()
    if query.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {query.exception()}")
    if not finished:
        raise TimeoutError(f"stream {name} did not finish within {timeout_s}s")


def stream_progress_latest(log: DataFrame) -> DataFrame:
    """Latest progress per user of a streaming progress log (twin of D12)."""
    payload = [c for c in log.columns if c != "userid"]
    agg = log.groupBy("userid").agg(
        F.max_by(F.struct(*payload), F.struct("ts", "event_id")).alias("s")
    ).select("userid", "s.*")
    return read_keyed_table(log.sparkSession, run_keyed_updates(agg, "progress-latest", ["userid"]))


def newest_submissions(subs: DataFrame, json_col: str = "selecteddata") -> DataFrame:
    """Newest well-formed submission per user, as an update-mode aggregation."""
    return well_formed(subs, json_col).groupBy("userid").agg(
        F.max_by(F.struct("submission_id", "ts", json_col), F.struct("ts", "submission_id")).alias("s")
    ).select("userid", "s.*")


def stream_replace_ratings(subs: DataFrame, path: str, timeout_s: int | None = None,
                           views: Sequence[SignedView] = ()) -> None:
    """A stream of submissions replaces its users' rows in the keyed ratings
    table at ``path`` (``userid, movieid, rating, timestamp``), which may be empty, and keeps
    its signed ``views``.

    State: the newest well-formed submission per user.  Every micro-batch rewrites
    the rows of the users it touched, with the accepted items of that submission
    (none: the user's rows go).  A replayed batch is a no-op; one whose submissions
    are all older writes the same rows again."""
    def replace(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.checkpoint(eager=True)
        if newest.isEmpty():
            return
        items = valid_submissions(newest).select(
            "userid", "movieid", "rating", epoch_seconds("ts").alias("timestamp")).checkpoint(eager=True)
        replace_with_views(spark, path, items, "userid", views, replaced=newest, batch=("submissions", batch_id))

    query = (newest_submissions(subs).writeStream.outputMode("update").foreachBatch(replace)
             .option("checkpointLocation", scratch_path(subs.sparkSession, "replace-ratings-ckpt"))
             .trigger(availableNow=True).start())
    _finish(query, "replace-ratings", timeout_s)


def stream_favorites_dedup(requests: DataFrame, views: Sequence[SignedView] = ()) -> DataFrame:
    """First insert of each (user, movie, category) wins (twin of the
    favourites table): the first request per key, kept as streaming state."""
    agg = requests.where(F.col("category").isNotNull()).groupBy("userid", "movieid", "category").agg(
        F.min(F.struct("ts", "event_id")).alias("f")).select(
            "userid", "movieid", "category", F.col("f.event_id").alias("id"), F.col("f.ts").alias("createtime"))
    keys = ["userid", "movieid", "category"]
    return read_keyed_table(requests.sparkSession, run_keyed_updates(agg, "favorites-dedup", keys, views))


def stream_favorites_dedup_bounded(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """S6, bounded state: duplicates of a key arriving within ``delay`` of each
    other (event time) are dropped and the key's state expires after the
    watermark passes; a row later than the watermark is dropped, as is usual
    for a bounded state.  The kept row is the first to arrive, so this variant
    guarantees the key set, not the minimum id.  ``withWatermark`` needs a
    TIMESTAMP, so the NTZ event time is cast first (session time zone UTC)."""
    spark = requests.sparkSession
    fav = requests.where(F.col("category").isNotNull()).withColumn("event_time", F.col("ts").cast("timestamp"))
    dedup = fav.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["userid", "movieid", "category"])
    out = scratch_path(spark, "favorites-dedup-bounded-out")
    ckpt = scratch_path(spark, "favorites-dedup-bounded-ckpt")
    query = (dedup.drop("event_time").writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _finish(query, "favorites-dedup-bounded")
    return spark.read.parquet(out)
