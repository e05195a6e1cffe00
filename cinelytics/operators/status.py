"""Job status and progress: latest state per user, upsert, the two status
endpoints, the stage table, the monotone progress bar, selection progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.ranking import running_max_within

# --- Fixed values: progress stages of the batch job and their messages --------
STAGES = [
    (5, "初始化 Spark 引擎"),
    (10, "清空历史推荐结果"),
    (20, "加载用户个性评分"),
    (30, "评分数据处理完毕"),
    (40, "加载 MovieLens 大数据集"),
    (60, "训练模型"),
    (80, "最佳模型已找到，生成推荐中"),
    (100, "推荐完成"),
    (-1, "错误"),
]
COMPLETED_AT = 100
FALLBACK_PROGRESS = 50  # ratings exist but no progress row and no results yet
DONE_STEP = "推荐已生成"
DONE_MESSAGE = ("推荐已生成，共 ", " 部电影")  # around the number of results
RUNNING_STEP, RUNNING_MESSAGE = "正在计算推荐", "正在生成推荐，请稍候..."
NO_DATA_STEP, NO_DATA_MESSAGE = "等待评分数据", "暂无评分数据"
STARTING_MESSAGE = "初始化 Spark 推荐引擎..."
BAR_START = 10  # the browser's progress bar starts here and never goes back
# -----------------------------------------------------------------------------


def progress_latest(log: DataFrame, key: str = "userid", order=("ts", "event_id")) -> DataFrame:
    """Last state per key of an append-only progress log (``REPLACE INTO``
    semantics) as a partial aggregate: ``max_by(row, (ts, seq))``."""
    payload = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("__s")).select(key, "__s.*")


def progress_upsert(state: DataFrame, updates: DataFrame, key: str = "userid", order=("ts", "event_id")) -> DataFrame:
    """Replace-by-key: the newest update of a key replaces its state row."""
    newest = progress_latest(updates, key, order)
    return state.join(newest.select(key), key, "left_anti").unionByName(newest.select(*state.columns))


def user_facts(progress_log: DataFrame, recs: DataFrame, ratings: DataFrame,
               order=("ts", "event_id")) -> DataFrame:
    """One row per user seen in any of the three tables: latest progress and
    step, number of recommendations, number of ratings.

    Each table is aggregated to one row per user first (ratings and results by a
    hash aggregate that carries a count only); the joins of these tables reuse
    the aggregates' partitioning on ``userid``."""
    latest = progress_latest(progress_log.select("userid", "progress", "step", *order), order=order)
    n_recs = recs.groupBy("userid").agg(F.count(F.lit(1)).alias("n_recs"))
    n_ratings = ratings.groupBy("userid").agg(F.count(F.lit(1)).alias("n_ratings"))
    facts = latest.select("userid", "progress", "step").join(n_recs, "userid", "full").join(
        n_ratings, "userid", "full")
    return facts.fillna(0, subset=["n_recs", "n_ratings"])


def user_facts_of(users: DataFrame, progress_log: DataFrame, recs: DataFrame, ratings: DataFrame,
                  order=("ts", "event_id")) -> DataFrame:
    """``user_facts`` of the given distinct users.  Left joins keep the users' partitioning
    (a full join keeps none), so four tables stored in buckets of ``userid`` are
    aggregated and joined without an exchange."""
    latest = progress_latest(progress_log.select("userid", "progress", "step", *order), order=order)
    facts = users.select("userid").join(latest.select("userid", "progress", "step"), "userid", "left")
    for rows, n in ((recs, "n_recs"), (ratings, "n_ratings")):
        facts = facts.join(rows.groupBy("userid").agg(F.count(F.lit(1)).alias(n)), "userid", "left")
    return facts.fillna(0, subset=["n_recs", "n_ratings"])


def count_recommendations_by_user(users: DataFrame, recs: DataFrame) -> DataFrame:
    """Recommendations per user, zero for users without any."""
    counts = recs.groupBy("userid").agg(F.count(F.lit(1)).alias("n_recommendations"))
    return users.select("userid").distinct().join(counts, "userid", "left").select(
        "userid", F.coalesce(F.col("n_recommendations"), F.lit(0)).cast("long").alias("n_recommendations")
    )


def _for_users(facts: DataFrame, users: DataFrame | None) -> DataFrame:
    """Facts of the given users (unknown users get an all-NULL row), or of every
    user that appears in the facts."""
    if users is None:
        return facts
    return users.select("userid").distinct().join(facts, "userid", "left")


def job_status(facts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The detailed status endpoint for every user of ``user_facts`` (or for
    ``users``, which may include users found in no table).

    progress row: >= 100 completed (with the result count), else processing at
    its value; no row: results -> completed, ratings -> processing at 50, else
    no_data at 0.  ``failed`` marks progress -1, which the original reports as
    processing.  ``step`` and ``message`` are the row's step or the defaults."""
    has_row = F.col("progress").isNotNull()
    recs_n = F.coalesce(F.col("n_recs"), F.lit(0))
    ratings_n = F.coalesce(F.col("n_ratings"), F.lit(0))
    done = has_row & (F.col("progress") >= COMPLETED_AT)
    status = (
        F.when(done, "completed")
        .when(has_row, "processing")
        .when(recs_n > 0, "completed")
        .when(ratings_n > 0, "processing")
        .otherwise("no_data")
    )
    progress = (
        F.when(done, COMPLETED_AT)
        .when(has_row, F.col("progress"))
        .when(recs_n > 0, COMPLETED_AT)
        .when(ratings_n > 0, FALLBACK_PROGRESS)
        .otherwise(0)
    )
    own_step = F.nullif(F.col("step"), F.lit(""))  # JavaScript: '' is falsy
    found = F.concat(F.lit(DONE_MESSAGE[0]), recs_n.cast("string"), F.lit(DONE_MESSAGE[1]))
    step = (
        F.when(done, F.coalesce(own_step, F.lit(DONE_STEP)))
        .when(has_row, F.coalesce(own_step, F.lit(RUNNING_STEP)))
        .when(recs_n > 0, DONE_STEP).when(ratings_n > 0, RUNNING_STEP).otherwise(NO_DATA_STEP)
    )
    message = (
        F.when(done, found)
        .when(has_row, F.coalesce(own_step, F.lit(RUNNING_MESSAGE)))
        .when(recs_n > 0, found).when(ratings_n > 0, RUNNING_MESSAGE).otherwise(NO_DATA_MESSAGE)
    )
    return _for_users(facts, users).select(
        "userid", status.alias("status"), progress.cast("int").alias("progress"),
        step.alias("step"), message.alias("message"),
        F.when(status == "completed", recs_n).cast("long").alias("rec_count"),
        F.coalesce(F.col("progress") == -1, F.lit(False)).alias("failed"),
    )


def job_status_simple(facts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The simple endpoint: completed at >= 100, otherwise running; no progress
    row gives running at 0."""
    p = F.col("progress")
    return _for_users(facts, users).select(
        "userid",
        F.when(p >= COMPLETED_AT, "completed").otherwise("running").alias("status"),
        F.coalesce(p, F.lit(0)).cast("int").alias("progress"),
        F.when(p.isNull(), STARTING_MESSAGE).otherwise(F.col("step")).alias("message"),
    )


def stage_table(spark) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage_progress int, stage_label string")


def progress_stages(log: DataFrame) -> DataFrame:
    """Label each progress row with its job stage (NULL for values that are not
    a stage); the stage table is a fixed nine-row dimension."""
    stages = F.broadcast(stage_table(log.sparkSession))
    return log.join(stages, log["progress"] == stages["stage_progress"], "left").drop("stage_progress")


def progress_monotone(log: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Progress as the browser shows it: the running maximum per user, starting
    at 10 (``max(current, new)``).  Hot users are split over tasks."""
    run = running_max_within(log, ["userid"], [F.col(c).asc() for c in order], "progress", "__max")
    return run.withColumn("shown_progress", F.greatest(F.lit(BAR_START), F.col("__max"))).drop("__max")


def selection_progress(selected_counts: DataFrame, n_col: str = "n_selected",
                       minimum: int = C.MIN_SELECTION) -> DataFrame:
    """Selection page: percent towards the minimum (capped at 100), movies still
    needed, and whether the user may continue."""
    n = F.col(n_col)
    return selected_counts.withColumn("percent", F.least(n / minimum * 100, F.lit(100.0))) \
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(minimum) - n).cast("int")) \
        .withColumn("ready", n >= minimum)
