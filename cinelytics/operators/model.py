"""Models: the popularity predictor and ALS (fit, predict, grid search, choice,
report, recommendations for one user and for many)."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TOP_N, is_finite, is_positive_prediction
from ..plans.joins import join_dimension
from ..session import checkpoint_root, free_unused, scratch_path, stored
from .evaluate import DOUBLE_MAX, rmse
from .mips import best_unseen

# --- Fixed values of the original job ----------------------------------------
GRID_RANKS = (8, 12)
GRID_REGS = (0.1, 10.0)
GRID_ITERS = (10, 20)
FALLBACK_RANK, FALLBACK_ITER, FALLBACK_REG = 10, 10, 0.01
# -----------------------------------------------------------------------------
DEFAULT_SEED = 42
GRID_PARALLELISM = 4  # cells at a time: bounds what the driver and the cluster hold at once
# ALS keeps user blocks x item blocks builders in every map task, so their number follows the
# ratings and the product stays bounded.
ROWS_PER_BLOCK = 1_000_000
MIN_BLOCKS, MAX_BLOCKS = 10, 1_000
# Every iteration sends a user's factors to each block that holds an item of theirs, and an item's to
# each block with one of its users: a fit's blocks are as large as a task can hold (about 12 bytes a rating).
FIT_ROWS_PER_BLOCK = 32_000_000
FIT_BLOCKS = 6  # of a fit that runs alone on enough cores
CHECKPOINT_INTERVAL = 2  # iterations whose shuffle files are on disk at a time
METRICS_SCHEMA = ("grid_order int, rank int, reg_param double, max_iter int, rmse double, n_pairs long, "
                  "status string, error string")


# ---------------------------------------------------------------- popularity --

def item_means(train: DataFrame, item_col: str = "movieid", rating_col: str = "rating") -> DataFrame:
    return train.groupBy(item_col).agg(F.avg(rating_col).alias("item_mean"), F.count(F.lit(1)).alias("n_train"))


def popularity_scores(catalog: DataFrame, train: DataFrame, item_col: str = "movieid",
                      rating_col: str = "rating", keep=("moviename",)) -> DataFrame:
    """Score of every catalog item: its mean training rating, else the global mean."""
    sums = train.groupBy(item_col).agg(F.sum(rating_col).alias("__sum"), F.count(rating_col).alias("__n"))
    global_mean = sums.select(F.sum("__sum") / F.sum("__n")).scalar()  # from the same item sums: one pass over train
    cols = [item_col] + [c for c in keep if c in catalog.columns]
    return (
        catalog.select(*cols)
        .join(sums.select(item_col, (F.col("__sum") / F.nullif(F.col("__n"), F.lit(0))).alias("item_mean")), item_col, "left")
        .select(*cols, F.coalesce(F.col("item_mean"), global_mean).alias("prediction"))
    )


def popularity_predict(pairs: DataFrame, train: DataFrame, item_col: str = "movieid",
                       rating_col: str = "rating", cold_start: str = "nan") -> DataFrame:
    """Score (user, item[, label]) pairs with the item mean.  Items absent from
    training get NaN (``cold_start="nan"``, like ALS) or the global mean."""
    means = item_means(train, item_col, rating_col).select(item_col, "item_mean")
    out = join_dimension(pairs, means, item_col, "left")
    if cold_start == "mean":
        fallback = train.select(F.avg(rating_col)).scalar()
    else:
        fallback = F.lit(float("nan"))
    return out.withColumn("prediction", F.coalesce(F.col("item_mean"), fallback)).drop("item_mean")


# ------------------------------------------------------------------------ ALS --

@dataclass(frozen=True)
class AlsParams:
    rank: int
    reg: float
    max_iter: int


def grid(ranks=GRID_RANKS, regs=GRID_REGS, iters=GRID_ITERS) -> list[AlsParams]:
    """Loop order of the original job: rank, then lambda, then iterations."""
    return [AlsParams(r, l, i) for r, l, i in itertools.product(ranks, regs, iters)]


def als_fit(train: DataFrame, params: AlsParams, seed: int = DEFAULT_SEED, user_col: str = "userid",
            item_col: str = "movieid", rating_col: str = "rating", blocks: int | None = None):
    """Explicit-feedback ALS.  Ids must fit in 32 bits (checked).  ``blocks``: user / item
    blocks, by default derived from the number of ratings (``als_blocks``; the ratings are then
    stored once, counted and fitted).  Iterations are checkpointed into the shared checkpoint folder
    every ``CHECKPOINT_INTERVAL`` steps, which cuts the lineage and frees the shuffle files before it.
    One user's or item's ratings always share a block.

    The model comes back stored and read again: nothing holds the fit's cached blocks and
    shuffle files any more, however many models are kept."""
    from pyspark.ml.recommendation import ALS, ALSModel

    spark = train.sparkSession
    checkpoint_root(spark)
    ratings = train.select(_int_id(user_col), _int_id(item_col), F.col(rating_col).cast("float").alias(rating_col))
    if not blocks:
        ratings = stored(ratings, "als-ratings")
    nblocks = blocks or als_blocks(ratings)
    als = ALS(
        rank=params.rank, maxIter=params.max_iter, regParam=params.reg, seed=seed,
        userCol=user_col, itemCol=item_col, ratingCol=rating_col,
        coldStartStrategy="nan", numUserBlocks=nblocks, numItemBlocks=nblocks, checkpointInterval=CHECKPOINT_INTERVAL,
    )
    path = scratch_path(spark, "als-model")
    als.fit(ratings).write().save(path)
    free_unused(spark)
    return ALSModel.load(path)


def block_count(n_rows: int, cores: int = MIN_BLOCKS, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    """A block per ``rows_per_block`` ratings; a small set gets a block per core, up to ``MIN_BLOCKS``."""
    return max(min(MIN_BLOCKS, cores), min(MAX_BLOCKS, -(-n_rows // rows_per_block)))


def als_blocks(ratings: DataFrame, at_once: int = 1) -> int:
    """Blocks for stored ratings (counted from the files), of which ``at_once`` fits run together: with
    their tasks side by side each needs fewer blocks to keep the cores busy."""
    cores = ratings.sparkSession.sparkContext.defaultParallelism // at_once
    return block_count(ratings.count(), max(2, min(FIT_BLOCKS, cores)), FIT_ROWS_PER_BLOCK)


def _int_id(c: str):
    """ALS ids must be 32-bit: fail with a clear message inside the scan that
    feeds ALS (no extra pass over the data), whatever the ANSI setting."""
    x = F.col(c)
    ok = x.isNull() | x.between(-(2 ** 31), 2 ** 31 - 1)
    return F.when(ok, x.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"{c} out of the 32-bit range ALS supports: "), x.cast("string")))
    ).cast("int").alias(c)


def als_predict(model, pairs: DataFrame) -> DataFrame:
    """Score pairs; a user or item unseen in training gives NaN."""
    return model.transform(pairs)


def als_grid_search(train: DataFrame, validation: DataFrame, params: list[AlsParams] | None = None,
                    seed: int = DEFAULT_SEED, keep_models: bool = False, parallelism: int = GRID_PARALLELISM):
    """Fit every grid cell on the stored training set and score it on validation.

    Returns ``(metrics, models)``: metrics has one row per cell (``grid_order``,
    ``rank``, ``reg_param``, ``max_iter``, ``rmse``, ``n_pairs``, ``status``,
    ``error``); a failing cell is recorded as ``failed`` with a NaN RMSE and its
    message, as the original loop tolerates it.  Ids that ALS cannot hold fail
    before the loop.  Cells run as concurrent jobs, ``parallelism`` at a time, each in a
    scheduler pool of its own (used where ``spark.scheduler.mode`` is FAIR), so the tail of
    one fit doesn't leave the cluster idle; only scalar RMSEs return to the driver."""
    from pyspark import inheritable_thread_target

    spark = train.sparkSession
    params = params or grid()
    ratings = stored(train.select(_int_id("userid"), _int_id("movieid"), F.col("rating").cast("float").alias("rating")),
                     "als-ratings")
    validation = stored(validation, "als-validation")
    blocks = als_blocks(ratings, max(1, parallelism))

    def cell(order: int, p: AlsParams):
        name = (order, p.rank, float(p.reg), p.max_iter)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"als-cell-{order}")
        try:
            model = als_fit(ratings, p, seed, blocks=blocks)
            score = rmse(als_predict(model, validation)).first()
            return (*name, float(score["rmse"]), score["n_pairs"], "ok", None), model
        except Exception as e:  # noqa: BLE001 - a failing cell is part of the result
            return (*name, float("nan"), 0, "failed", f"{type(e).__name__}: {e}"[:500]), None

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        # a wrapper per cell: each job thread gets its own copy of the caller's local properties
        jobs = [pool.submit(inheritable_thread_target(spark)(cell), i, p) for i, p in enumerate(params)]
        done = [j.result() for j in jobs]
    models = {row[0]: model for row, model in done if keep_models and model is not None}
    return spark.createDataFrame([row for row, _ in done], METRICS_SCHEMA), models


def store_grid(metrics: DataFrame, models: dict, path: str) -> None:
    """Write a grid's metrics and fitted models; the metrics last, so a folder with them is whole."""
    for order, model in models.items():
        model.write().overwrite().save(f"{path}/model-{order}")
    metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")


def load_grid(spark, path: str):
    """``(metrics, models)`` of a stored grid."""
    from pyspark.ml.recommendation import ALSModel

    metrics = spark.read.schema(METRICS_SCHEMA).parquet(f"{path}/metrics")
    fitted = [r[0] for r in metrics.where("status = 'ok'").select("grid_order").collect()]  # a row per cell
    return metrics, {i: ALSModel.load(f"{path}/model-{i}") for i in fitted}


def select_best_model(metrics: DataFrame) -> DataFrame:
    """First strict minimum of a finite validation RMSE in grid order; if no cell
    qualifies, the fallback parameters (rank 10, 10 iterations, lambda 0.01)."""
    spark = metrics.sparkSession
    valid = metrics.where(is_finite("rmse") & (F.col("rmse") < DOUBLE_MAX)).select(
        "grid_order", "rank", "reg_param", "max_iter", "rmse", F.lit(False).alias("is_fallback")
    )
    fallback = spark.createDataFrame(
        [(-1, FALLBACK_RANK, FALLBACK_REG, FALLBACK_ITER, None, True)],
        "grid_order int, rank int, reg_param double, max_iter int, rmse double, is_fallback boolean",
    )
    return valid.unionByName(fallback).orderBy("is_fallback", "rmse", "grid_order").limit(1)


def model_report(best: DataFrame, test_rmse: float, baseline: float) -> DataFrame:
    """One row: best parameters, validation and test RMSE, baseline, improvement."""
    from .evaluate import improvement_pct

    return best.select(
        "rank", "reg_param", "max_iter", F.col("rmse").alias("validation_rmse"), "is_fallback",
        F.lit(test_rmse).alias("test_rmse"), F.lit(baseline).alias("baseline_rmse"),
    ).withColumn("improvement_pct", improvement_pct("baseline_rmse", "test_rmse"))


def recommend_for_user(model, userid: int, catalog: DataFrame, seen: DataFrame, n: int = TOP_N,
                       item_col: str = "movieid") -> DataFrame:
    """The original per-user step: score the catalog minus the user's rated
    movies, keep positive predictions, best ``n`` (ties by id), with titles."""
    rated = seen.where(F.col("userid") == userid).select(item_col).distinct()
    candidates = (
        catalog.select(item_col).distinct()
        .join(rated, item_col, "left_anti")
        .select(F.lit(userid).cast("int").alias("userid"), F.col(item_col).cast("int"))
    )
    scored = als_predict(model, candidates).where(is_positive_prediction("prediction"))
    top = scored.orderBy(F.desc("prediction"), F.asc(item_col)).limit(n)
    return join_dimension(top, catalog.select(item_col, "moviename"), item_col)


def recommend_for_users(model, users: DataFrame, seen: DataFrame, catalog: DataFrame, n: int = TOP_N,
                        item_col: str = "movieid") -> DataFrame:
    """Best ``n`` unseen catalog movies with a positive prediction for every user that the
    model knows (``userid, movieid, prediction, rank``), ties by id.

    The exact norm-bounded search of ``mips.best_unseen`` over the model's factors of
    catalog movies.  A prediction is the product of the float factors summed in double
    precision and rounded to a float."""
    checkpoint_root(users.sparkSession)
    wanted = users.select(F.col("userid").cast("int").alias("id")).distinct()
    ids = catalog.select(F.col(item_col).cast("int").alias("id")).distinct()
    user_factors = model.userFactors.join(wanted, "id", "left_semi")
    item_factors = join_dimension(model.itemFactors, ids, "id", "left_semi")
    return best_unseen(user_factors, item_factors, seen, n, "userid", item_col)
