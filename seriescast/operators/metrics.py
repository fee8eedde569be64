"""Accuracy metrics over a long prediction table (AG1-AG7, AG11-AG13, AG21-AG23).

Input: ``keys..., actual, predicted`` (+ ``train_mean`` for the improvement
over the mean baseline).  All row-level metrics are one grouped aggregate
(algebraic, partially aggregated before the shuffle).  Formulas follow the
reference: population variances, sklearn's R^2 with its zero-variance rule,
MAPE with the 1e-10 guard on ``|actual|``, the tight band on ``e / (p + 1e-10)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.config import EPS, TIGHT_HI, TIGHT_LO


def regression_metrics(pred: DataFrame, keys: list[str], actual: str = "actual",
                       predicted: str = "predicted", train_mean: str | None = "train_mean") -> DataFrame:
    """``keys, n, mse, rmse, mae, r2, variance, mape, improvement, tight_pct,
    mean_error, std_error, axis_lo, axis_hi``."""
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    ratio = e / (p + EPS)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(a).alias("_var_a"),
        F.var_pop(e).alias("variance"),
        (F.avg(F.abs(e / (F.abs(a) + EPS))) * 100).alias("mape"),
        (F.count_if((ratio >= TIGHT_LO) & (ratio <= TIGHT_HI)) / F.count(F.lit(1)) * 100).alias("tight_pct"),
        F.avg(e).alias("mean_error"),
        F.stddev_pop(e).alias("std_error"),
        F.least(F.min(a), F.min(p)).alias("axis_lo"),
        F.greatest(F.max(a), F.max(p)).alias("axis_hi"),
    ]
    has_base = train_mean is not None and train_mean in pred.columns
    if has_base:
        # one row set for both errors: a group with a row without a train mean has no improvement
        aggs.append(F.when(F.count(train_mean) == F.count(F.lit(1)),
                           F.avg((a - F.col(train_mean)) * (a - F.col(train_mean)))).alias("_base"))
    m = pred.groupBy(*keys).agg(*aggs)
    sst = F.col("_var_a") * F.col("n")
    r2 = (F.when(sst == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(1 - F.col("_sse") / sst))
    m = m.withColumns({"rmse": F.sqrt("mse"), "r2": r2})
    imp = (F.try_divide(F.col("_base") - F.col("mse"), F.col("_base")) * 100
           if has_base else F.lit(None).cast("double"))
    m = m.withColumn("improvement", imp)
    cols = ["n", "mse", "rmse", "mae", "r2", "variance", "mape", "improvement", "tight_pct",
            "mean_error", "std_error", "axis_lo", "axis_hi"]
    return m.select(*keys, *cols)


def r2_score(pred: DataFrame, keys: list[str], actual: str = "actual",
             predicted: str = "predicted") -> DataFrame:
    """AG3 alone: ``keys, r2``."""
    m = regression_metrics(pred, keys, actual, predicted, train_mean=None)
    return m.select(*keys, "r2")


def macro_summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG11-AG13 over a metrics table (one row per parameter): unweighted means,
    quality counts and the forecast gate."""
    by = by or []
    r2 = F.col("r2")
    g = metrics.groupBy(*by) if by else metrics.groupBy()
    out = g.agg(
        F.count(F.lit(1)).alias("n_params"),
        F.avg("r2").alias("avg_r2"), F.avg("rmse").alias("avg_rmse"), F.avg("mae").alias("avg_mae"),
        F.avg("variance").alias("avg_variance"), F.avg("mape").alias("avg_mape"),
        F.avg("improvement").alias("avg_improvement"), F.avg("tight_pct").alias("avg_tight_pct"),
        F.count_if(r2 > 0.7).alias("n_good"),
        F.count_if((r2 > 0.5) & (r2 <= 0.7)).alias("n_acceptable"),
        F.count_if(r2 <= 0.5).alias("n_poor"),
    )
    gate = (F.when(F.col("avg_r2") > 0.6, F.lit("good"))
             .when(F.col("avg_r2") > 0.4, F.lit("moderate")).otherwise(F.lit("insufficient")))
    return out.withColumns({"quality": gate, "forecast_allowed": F.col("avg_r2") > 0.4})


def cv_summary(fold_scores: DataFrame, keys: list[str], score: str = "r2") -> DataFrame:
    """AG23: mean and population std of fold scores."""
    return fold_scores.groupBy(*keys).agg(F.avg(score).alias("cv_mean"),
                                          F.stddev_pop(score).alias("cv_std"))
