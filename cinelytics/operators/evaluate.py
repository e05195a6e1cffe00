"""Model evaluation: finite filter, RMSE (direct and pair-join form), baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite

DOUBLE_MAX = 1.7976931348623157e308  # RMSE of an empty evaluation: never the best


def finite_predictions(df: DataFrame, pred_col: str = "prediction", label_col: str = "rating") -> DataFrame:
    """Drop pairs whose prediction or label is NULL, NaN or infinite."""
    return df.where(is_finite(pred_col) & is_finite(label_col))


def rmse_expr(pred_col: str = "prediction", label_col: str = "rating") -> Column:
    """Aggregate expression: RMSE over finite pairs, ``Double.MaxValue`` if none."""
    ok = is_finite(pred_col) & is_finite(label_col)
    sq = F.when(ok, F.pow(F.col(pred_col) - F.col(label_col), 2))
    return F.coalesce(F.sqrt(F.avg(sq)), F.lit(DOUBLE_MAX))


def rmse(predictions: DataFrame, pred_col: str = "prediction", label_col: str = "rating") -> DataFrame:
    """One row: ``rmse`` and ``n_pairs`` (finite pairs used).  The label travels
    with the prediction, so no join is needed and duplicate pairs count once each."""
    ok = is_finite(pred_col) & is_finite(label_col)
    return predictions.agg(
        rmse_expr(pred_col, label_col).alias("rmse"),
        F.count(F.when(ok, F.lit(1))).alias("n_pairs"),
    )


def rmse_pair_join(predictions: DataFrame, actuals: DataFrame, keys=("userid", "movieid"),
                   pred_col: str = "prediction", label_col: str = "rating") -> DataFrame:
    """The original evaluation: join predictions to actuals on (user, item), so a
    pair that occurs k times on each side contributes k*k rows."""
    keys = list(keys)
    joined = predictions.select(*keys, pred_col).join(actuals.select(*keys, label_col), keys)
    return rmse(joined, pred_col, label_col)


def mean_rating(df: DataFrame, rating_col: str = "rating") -> DataFrame:
    return df.agg(F.avg(rating_col).alias("mean_rating"))


def baseline_rmse(test: DataFrame, mean_df: DataFrame, rating_col: str = "rating") -> DataFrame:
    """RMSE of always predicting the global mean (``mean_df`` is one row, used as a
    scalar subquery)."""
    mean = mean_df.select(F.first("mean_rating")).scalar()
    return test.agg(F.sqrt(F.avg(F.pow(F.col(rating_col) - mean, 2))).alias("baseline_rmse"))


def improvement_pct(baseline: Column | str, model_rmse: Column | str) -> Column:
    """``(baseline - rmse) / baseline * 100``; NULL instead of an ANSI error on 0."""
    b = F.col(baseline) if isinstance(baseline, str) else baseline
    m = F.col(model_rmse) if isinstance(model_rmse, str) else model_rmse
    return F.try_divide(b - m, b) * 100
