"""Blends, model choice and the ridge meta-learner (ML7-ML11, ML13).

Candidate predictions are long: ``keys..., model, actual, predicted``.
Per-parameter constants (weights, the chosen model, ridge coefficients) are
small tables keyed by parameter: their rows are counted and they are broadcast, so the
candidate rows stay where they are (``small_side``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriescast.operators.metrics import r2_score
from seriescast.operators.series import small_side


def wide_candidates(pred: DataFrame, ids: list[str], models: list[str]) -> DataFrame:
    """``ids, actual, <model>...`` from the long candidate table."""
    return (pred.groupBy(*ids).pivot("model", models)
                .agg(F.first("predicted"))
                .join(pred.groupBy(*ids).agg(F.first("actual").alias("actual")), ids))


def fixed_blend(pred: DataFrame, weights: dict[str, float], name: str = "blend") -> DataFrame:
    """ML7: ``sum(w_m * p_m)`` for rows that have every member; returns long rows of ``name``.

    ``pred`` is long, or holds one column per member (then the blend is a projection of its rows)."""
    if "model" not in pred.columns:
        members = [F.lit(float(v)) * F.col(m) for m, v in weights.items()]
        blend = sum(members[1:], members[0])
        return (pred.withColumns({"predicted": blend, "model": F.lit(name)}).where(F.col("predicted").isNotNull()))
    ids = [c for c in pred.columns if c not in ("model", "predicted")]
    members = pred.where(F.col("model").isin(list(weights)))
    w = F.create_map(*[x for m, v in weights.items() for x in (F.lit(m), F.lit(float(v)))])
    return (members.groupBy(*ids)
                   .agg(F.sum(w[F.col("model")] * F.col("predicted")).alias("predicted"),
                        F.count(F.lit(1)).alias("_k"))
                   .where(F.col("_k") == len(weights)).drop("_k")
                   .withColumn("model", F.lit(name)))


def r2_weights(pred: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """ML8: ``keys, model, weight`` with ``w = r2 / sum(r2)`` (each 0.33 when the sum
    is not positive), renormalised to sum 1."""
    r2 = r2_score(pred.where(F.col("model").isin(models)), keys + ["model"])
    w = Window.partitionBy(*keys)       # over the scores: the rows behind them are read once
    tot = F.sum("r2").over(w)
    d = r2.dropna(subset=keys).withColumn("_w", F.when(tot > 0, F.col("r2") / tot).otherwise(F.lit(0.33)))
    return d.withColumn("_ws", F.sum("_w").over(w)).select(*keys, "model", (F.col("_w") / F.col("_ws")).alias("weight"))


def weighted_blend(pred: DataFrame, weights: DataFrame, keys: list[str], name: str = "weighted") -> DataFrame:
    """Apply ML8 weights (joined on ``keys + model``)."""
    ids = [c for c in pred.columns if c not in ("model", "predicted")]
    d = pred.join(small_side(weights), keys + ["model"])
    return (d.groupBy(*ids).agg(F.sum(F.col("weight") * F.col("predicted")).alias("predicted"))
             .withColumn("model", F.lit(name)))


def choose(scores: DataFrame, keys: list[str], priority: list[str], score: str = "r2") -> DataFrame:
    """ML9-ML11: best score per group; ties go to the earlier model in ``priority``.
    Returns ``keys, chosen_model, chosen_score``."""
    order = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("model"))
    d = scores.where(F.col("model").isin(priority)).withColumn("_ord", order)
    return d.groupBy(*keys).agg(
        F.max_by("model", F.struct(F.col(score), -F.col("_ord"))).alias("chosen_model"),
        F.max(score).alias("chosen_score"))


def ridge_fit(pred: DataFrame, keys: list[str], inputs: list[str], alpha: float = 1.0,
              label: str = "actual") -> DataFrame:
    """ML13: ridge with an unpenalised intercept, ``(Xc'Xc + aI) w = Xc'yc``.

    One grouped aggregate gives the means and, of every pair of columns, the covariance (Spark's own
    mergeable one - no cancellation from raw sums) with the means of the rows that hold both; the
    cross-products about the columns' means follow from them, so ``pred`` is read once.  Each group's
    small system is solved by numpy in ``applyInPandas``; a group is one row.  Groups with a null key are
    left out.  Returns ``keys, intercept, w_<input>``.
    """
    names = inputs + [label]
    aggs, cross = [F.avg(c).alias(f"_m_{c}") for c in names], []
    pairs = [(a, b, f"_xx_{a}__{b}") for i, a in enumerate(inputs) for b in inputs[i:]] + [(a, label, f"_xy_{a}") for a in inputs]
    for i, (a, b, name) in enumerate(pairs):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        aggs += [F.covar_pop(a, b).alias(f"_c{i}"), F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_x{i}"), F.avg(y).alias(f"_y{i}")]
        cross.append((F.col(f"_n{i}") * (F.col(f"_c{i}") + (F.col(f"_x{i}") - F.col(f"_m_{a}")) * (F.col(f"_y{i}") - F.col(f"_m_{b}")))).alias(name))
    sums = pred.dropna(subset=keys).groupBy(*keys).agg(*aggs).select(*keys, *[f"_m_{c}" for c in names], *cross)
    k = len(inputs)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            a = np.zeros((k, k))
            for i, x in enumerate(inputs):
                for j in range(i, k):
                    a[i, j] = a[j, i] = r[f"_xx_{x}__{inputs[j]}"]
            b = np.array([r[f"_xy_{x}"] for x in inputs])
            w = np.linalg.solve(a + alpha * np.eye(k), b)
            icpt = r[f"_m_{label}"] - float(np.dot([r[f"_m_{x}"] for x in inputs], w))
            rows.append([r[kk] for kk in keys] + [icpt] + list(w))
        return pd.DataFrame(rows, columns=keys + ["intercept"] + [f"w_{x}" for x in inputs])

    key_types = ", ".join(f"{kk} {dict(pred.dtypes)[kk]}" for kk in keys)
    schema = f"{key_types}, intercept double, " + ", ".join(f"w_{x} double" for x in inputs)
    return sums.groupBy(*keys).applyInPandas(solve, schema)


def ridge_cv(pred: DataFrame, keys: list[str], inputs: list[str], alpha: float = 1.0,
             label: str = "actual", seg: str = "seg") -> DataFrame:
    """ML15 for the ridge meta-learner: ``keys, fold, n_train, r2`` of expanding time folds.

    ``pred`` carries the segments of ``folds.time_segments``.  One grouped aggregate gives each
    segment's count, means and covariances (Spark's own mergeable aggregates); everything else is
    additive over segments: fold i's training side is the merge of segments 0 to i, and its test
    error follows from segment i + 1's moments without reading a row again.  Rows with a null
    input or label are left out; a fold without training or test rows has no score."""
    names = [*inputs, label]
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggs += [F.covar_pop(names[i], names[j]).alias(f"_c{i}_{j}") for i, j in pairs]
    stats = pred.dropna(subset=names).groupBy(*keys, seg).agg(*aggs)
    k = len(inputs)

    def moments(r: pd.Series) -> tuple[float, np.ndarray, np.ndarray]:
        cov = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"_c{i}_{j}"]
        return float(r["_n"]), np.array([r[f"_m{i}"] for i in range(k + 1)], dtype=float), cov * r["_n"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {int(r[seg]): moments(r) for _, r in pdf.iterrows()}
        rows = []
        n, mean, cross = 0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1))
        for fold in range(max(by)):
            if fold in by:      # merge the next piece of the training side
                m, mu, c = by[fold]
                d = mu - mean
                cross = cross + c + np.outer(d, d) * (n * m / (n + m))
                mean, n = mean + d * (m / (n + m)), n + m
            if not n or fold + 1 not in by:
                continue
            w = np.linalg.solve(cross[:k, :k] + alpha * np.eye(k), cross[:k, k])
            icpt = mean[k] - mean[:k] @ w
            m, mu, c = by[fold + 1]
            e = np.append(-w, 1.0)      # residual = e . (inputs, label) - intercept
            sse, sst = e @ c @ e + m * (e @ mu - icpt) ** 2, c[k, k]
            r2 = (1.0 if abs(sse) < 1e-20 else 0.0) if sst == 0 else 1 - sse / sst
            rows.append([*[pdf[kk].iloc[0] for kk in keys], fold, int(n), r2])
        return pd.DataFrame(rows, columns=[*keys, "fold", "n_train", "r2"])

    key_types = ", ".join(f"{kk} {dict(pred.dtypes)[kk]}" for kk in keys)
    return stats.groupBy(*keys).applyInPandas(score, f"{key_types}, fold int, n_train long, r2 double")


def ridge_predict(wide: DataFrame, coefs: DataFrame, keys: list[str], inputs: list[str],
                  name: str = "stack") -> DataFrame:
    d = wide.join(small_side(coefs), keys)
    p = F.col("intercept")
    for x in inputs:
        p = p + F.col(f"w_{x}") * F.col(x)
    return d.withColumn("predicted", p).withColumn("model", F.lit(name))
