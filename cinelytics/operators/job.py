"""The whole recommendation job: own ratings, split, fit, best model, unseen movies,
stored results replaced, progress logged at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import TOP_N
from ..sources.tables import append_rows, ensure_keyed_table, replace_by_key
from .model import AlsParams, als_fit, als_grid_search, recommend_for_users, select_best_model
from .split import positive_ratings, split_part, training_union
from .status import STAGES

_schema = StructType.fromDDL
STAGE_LABELS = dict(STAGES)
FAILED = -1


def progress_rows(users: DataFrame, progress: int, seq: int) -> DataFrame:
    """One log row per user for a stage of the job."""
    return users.select("userid", F.lit(seq).cast("long").alias("event_id"), F.current_timestamp().alias("ts"),
                        F.lit(progress).alias("progress"), F.lit(STAGE_LABELS[progress]).alias("step"))


def run_job(users: DataFrame, own: DataFrame, sample: DataFrame, catalog: DataFrame, results_path: str,
            progress_path: str, params: list[AlsParams] | None = None, n: int = TOP_N, search=als_grid_search) -> None:
    """Run the job for a set of users in one model.

    ``params``: the grid's cells, by default all eight.  ``search(training, validation, params,
    keep_models=True)`` fits and scores them; one that loads a stored grid of the same input will do.
    Both tables are created empty where there are none.

    ``results_path``: keyed table (``userid, movieid, degree``) whose rows of these
    users are replaced; a user without a recommendation ends with no row.
    ``progress_path``: keyed progress log (``userid, event_id, ts, progress, step``)
    that gets a row per user and stage, and a row at -1 when the job fails; the
    failure is raised again, and the stored results are untouched unless the
    failure came while they were written."""
    spark = users.sparkSession
    users = users.select("userid").distinct().checkpoint(eager=True)
    seq = 0

    def at(progress: int) -> None:
        nonlocal seq
        seq += 1
        append_rows(progress_rows(users, progress, seq), progress_path, "userid")

    ensure_keyed_table(spark, results_path, _schema("userid int, movieid int, degree float"), "userid")
    ensure_keyed_table(spark, progress_path, progress_rows(users, 5, 0).schema, "userid")
    try:
        at(5)
        at(20)
        own = positive_ratings(own, require_nonempty=True)
        train, validation = split_part(sample, "train"), split_part(sample, "validation")
        training = training_union(train, own)
        at(40)
        at(60)
        metrics, models = search(training, validation, params, keep_models=True)
        best = select_best_model(metrics).first()
        model = models.get(best["grid_order"]) or als_fit(
            training, AlsParams(best["rank"], best["reg_param"], best["max_iter"]))
        at(80)
        seen = own.join(users, "userid", "left_semi").select("userid", "movieid")
        recs = recommend_for_users(model, users, seen, catalog, n).select(
            "userid", "movieid", F.col("prediction").cast("float").alias("degree"))
        replace_by_key(spark, results_path, recs, "userid", replaced=users)
        at(100)
    except Exception:
        at(FAILED)
        raise
