"""Baseline candidates and the evaluation chain on derived series.

The reference chooses among learners by test R^2, blends them and scores the
choice.  The same chain runs here on candidates that need no learner, so every
step (metrics, weights, choice, variance analysis, forecast) can be checked by
SQL.  MLlib learners plug into the same long table (``plans.train``).

Candidates per (site, param, day) on the test split:

* ``persistence`` - yesterday's value (WN7 lag 1, back-filled)
* ``roll7``       - mean of the previous 7 values (first row: its own value)
* ``climatology`` - train mean of the (site, param, month), else of (site, param)
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescast.operators import rolling as R
from seriescast.config import PARAMS
from seriescast.operators.batches import Span
from seriescast.operators.fill import interpolate, sentinel_to_null
from seriescast.operators.series import TASK_ROWS, WHOLE_TASKS, Series, spread, task_parts, with_halo
from seriescast.sources.fixtures import TEST_START, observations_wide, site_col, split_col, table

BASE_MODELS = ["persistence", "roll7", "climatology"]
# tie order of the choice: the blend first, then the members in list order
CHOICE_ORDER = ["weighted", "persistence", "roll7", "climatology"]
# columns of a candidate row, and where a row of all parameters holds them
CANDIDATE = {"actual": "{p}", **{c: f"{c}_{{p}}" for c in ("train_mean", *BASE_MODELS)}}
FIXED_BLEND = {"persistence": 0.6, "climatology": 0.4}


def days_series(spark: SparkSession, sf_dir: str, s: Series | None = None, grain: str = "supp",
                whole: bool = True, batches: bool = False, share: float = WHOLE_TASKS,
                untimed: bool = True) -> Series:
    """``s`` for site days with one column per parameter: keyed by site, tasks by the rows of the input.

    The rows of every site are counted: where none has more than a few tasks' share, sites stay whole.  A larger one has its
    time cut into buckets and blocks, as every series has without ``whole`` (for operators with blocks of their own).
    ``share`` is how many tasks' rows.  With ``batches`` whole sites are cleaned by Arrow batches, for operators that read them so (no windows after it);
    without ``untimed`` only where every row has a time."""
    s = s or Series()
    sizes = table(spark, sf_dir, "lineitem").groupBy(site_col(grain).alias("site")).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.to_date("l_shipdate").isNull()).alias("u"))
    rows, most, no_time = sizes.agg(F.sum("c"), F.max(F.when(F.col("site").isNotNull(), F.col("c"))), F.sum("u")).first()
    whole = whole and (most or 0) <= share * TASK_ROWS
    return replace(s, keys=tuple(k for k in s.keys if k != "param"), dealt=("site",), parts=task_parts(spark, rows or 0),
                   whole=whole, batches=batches and whole and (untimed or not no_time))


def cleaned_days(spark: SparkSession, sf_dir: str, days: Series, params: list[str] | None = None,
                 grain: str = "supp", timed: bool = False) -> DataFrame:
    """Site days with one column per parameter, sentinels nulled and gaps interpolated; with ``rn``, ``n``
    (``timed``: rows without a time are not counted in them).
    All parameters of a site share their days, so they are numbered and filled together; with ``split``
    among the keys of ``days``, the train and the test days of a site each on their own."""
    params = params or PARAMS
    obs = observations_wide(spark, sf_dir, grain, s=days).withColumn("split", split_col("ts"))
    obs = obs.where(F.col("ts").isNotNull()) if timed else obs
    return interpolate(obs.select(*days.keys, "ts", "_tb", *[sentinel_to_null(p).alias(p) for p in params]), days, params)


def blocked_days(wide: DataFrame, days: Series, halo: int) -> DataFrame:
    """Site days in blocks with their halo (``_blk``, ``_own``), dealt out by site and block; whole sites as one block."""
    if days.whole:
        return wide.drop("_tb").withColumns({"_blk": F.lit(0).cast("long"), "_own": F.lit(True)})
    return spread(with_halo(wide.drop("_tb"), days, halo), days, "site", "_blk")


def by_param(wide: DataFrame, params: list[str] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """One row per parameter, made inside the tasks (rows stay where they are): the other columns, ``param``
    and ``columns`` (name -> column with ``{p}`` for the parameter; ``value`` of it by default)."""
    params, columns = params or PARAMS, columns or {"value": "{p}"}
    used = {c.format(p=p) for c in columns.values() for p in PARAMS}
    rows = F.array(*[F.struct(F.lit(p).alias("param"), *[F.col(c.format(p=p)).alias(k) for k, c in columns.items()])
                     for p in params])
    kept = [c for c in wide.columns if c not in used]
    return wide.select(*kept, F.explode(rows).alias("_p")).select(*kept, "_p.*")


def cleaned(spark: SparkSession, sf_dir: str, grain: str = "supp", s: Series | None = None,
            param: str | None = None, halo: int | None = None) -> DataFrame:
    """Long observations, sentinels nulled and gaps interpolated; with ``rn``, ``n``.
    ``param`` keeps one parameter; with ``halo`` the rows lie in blocks (``_blk``, ``_own``)."""
    params = [param] if param else PARAMS
    days = days_series(spark, sf_dir, s, grain)
    wide = cleaned_days(spark, sf_dir, days, params, grain)
    return by_param(wide if halo is None else blocked_days(wide, days, halo), params)


def candidates_wide(wide: DataFrame, days: Series, params: list[str] | None = None) -> DataFrame:
    """Test-split rows of ``cleaned_days`` with one column per candidate:
    ``site, param, ts, actual, train_mean, persistence, roll7, climatology``."""
    return candidates_by_param(candidates_days(wide, days, params), days, params)


def candidates_by_param(test: DataFrame, days: Series, params: list[str] | None = None) -> DataFrame:
    """``candidates_days`` with one row per parameter."""
    return by_param(test, params, CANDIDATE).select("site", "param", days.order, *CANDIDATE)


def candidates_days(wide: DataFrame, days: Series, params: list[str] | None = None) -> DataFrame:
    """Test-split rows of ``cleaned_days`` with columns ``CANDIDATE`` for every parameter.

    The train means are one row per site: sums by month in one aggregate, put beside each other.  It is
    repeated for every block of the site, so the test rows meet it where they lie; windows find the rows of whole sites."""
    params = params or PARAMS
    if days.batches:
        stage = {"persistence_": R.lag_bfill("value", 1), "roll7_": WeekBefore("value"), "train_mean_": TrainMean("value", days.order),
                 "climatology_": TrainMean("value", days.order, monthly=True)}
        read = R.trailing_days(wide, days, [stage], params).where(split_col(days.order) == "test")
        return read.select("site", days.order, *params, *[F.col(f"{p}{c}").alias(f"{c}{p}") for p in params for c in stage])
    stage = {}
    for p in params:
        stage[f"persistence_{p}"] = R.lag_bfill(p, 1)
        stage[f"roll7_{p}"] = lambda w, p=p: F.coalesce(F.avg(p).over(w.rowsBetween(-7, -1)), F.col(p))
    read = R.trailing(blocked_days(wide, days, 8), days, [stage], halo=8)
    test, month = read.where(split_col(days.order) == "test"), F.month(days.order)
    if days.whole:
        known = {p: F.when(split_col(days.order) == "train", F.col(p)) for p in params}
        for name, w in (("train_mean", Window.partitionBy("site")), ("_clim", Window.partitionBy("site", month))):
            read = read.withColumns({f"{name}_{p}": F.avg(known[p]).over(w) for p in params})
        test = read.where(split_col(days.order) == "test").withColumns({
            f"climatology_{p}": F.coalesce(f"_clim_{p}", f"train_mean_{p}") for p in params})
        return test.select("site", days.order, *[c.format(p=p) for c in CANDIDATE.values() for p in params])
    train = wide.where(split_col(days.order) == "train")
    monthly = train.groupBy("site", month.alias("_m")).agg(F.max("n").alias("n"), *[e for p in params for e in (
        F.sum(p).alias(f"_s_{p}"), F.count(p).alias(f"_c_{p}"))])
    means = monthly.groupBy("site").agg(F.max("n").alias("_n"), *[e for p in params for e in (
        F.try_divide(F.sum(f"_s_{p}"), F.sum(f"_c_{p}")).alias(f"train_mean_{p}"),
        F.map_from_entries(F.collect_list(F.struct("_m", F.try_divide(f"_s_{p}", f"_c_{p}")))).alias(f"_clim_{p}"))])
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {days.block_rows}")))
    means = spread(means.withColumn("_blk", blocks).drop("_n"), days, "site", "_blk")
    test = test.join(means, ["site", "_blk"], "left").withColumns({
        f"climatology_{p}": F.coalesce(F.element_at(f"_clim_{p}", month), F.col(f"train_mean_{p}")) for p in params})
    return test.select("site", days.order, *[c.format(p=p) for c in CANDIDATE.values() for p in params])


@dataclass(frozen=True)
class WeekBefore:
    """Mean of the 7 values before, else the row's own, over whole series in batches."""

    col: str

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, np.ndarray]:
        x, total, count = np.where(ok, v, 0.0), np.zeros_like(v), np.zeros(v.shape)
        for k in range(7, 0, -1):
            total, count = total + at.back(x, k, 0.0), count + at.back(ok, k, False)
        return np.where(count > 0, total / np.maximum(count, 1), v), (count > 0) | ok


@dataclass(frozen=True)
class TrainMean:
    """Mean of the series' train rows, or (``monthly``) of those in the row's month if there are any."""

    col: str
    order: str
    monthly: bool = False

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, np.ndarray]:
        ts = at.memo["batch"][self.order]
        known = ok & pc.less(ts, pa.scalar(dt.date.fromisoformat(TEST_START))).to_numpy(zero_copy_only=False)

        def mean(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = [(np.bincount(group[k], x[k], minlength=group.max() + 1), np.bincount(group[k], minlength=group.max() + 1)) for x, k in zip(v, known)]
            total, count = (np.stack(x)[:, group] for x in zip(*got))
            return total / np.maximum(count, 1), count > 0

        whole, has = mean(at.own)
        if not self.monthly:
            return whole, has
        month, some = mean(at.own * 13 + pc.month(ts).to_numpy(zero_copy_only=False))
        return np.where(some, month, whole), some | has


def model_days(test: DataFrame, days: Series, model: str) -> DataFrame:
    """``candidates_days`` with one model's predictions beside the values: ``<p>`` and ``predicted_<p>``."""
    return test.select("site", days.order, *PARAMS, *[F.col(f"{model}_{p}").alias(f"predicted_{p}") for p in PARAMS])


def to_long(wide: DataFrame, models: list[str], ids: list[str]) -> DataFrame:
    """``ids..., model, actual, predicted, train_mean`` from model columns; rows without a
    prediction are left out."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models])
    out = wide.select(*ids, "actual", "train_mean", F.explode(arr).alias("_c"))
    return (out.select(*ids, "_c.model", "actual", "_c.predicted", "train_mean")
               .where(F.col("predicted").isNotNull()))


def candidates(wide: DataFrame, days: Series) -> DataFrame:
    """Long candidates on the test split: ``site, param, ts, model, actual, predicted, train_mean``."""
    return to_long(candidates_wide(wide, days), BASE_MODELS, ["site", "param", days.order])


def site_facts(wide: DataFrame, params: list[str] | None = None) -> DataFrame:
    """One row per site of ``cleaned_days``: its last day ``ts`` and, of every parameter, the value on it (``last_<p>``), the
    train mean (``train_mean_<p>``) and the train means by month (map ``clim_<p>``); sums by month first."""
    params = params or PARAMS
    known = {p: F.when(split_col("ts") == "train", F.col(p)) for p in params}
    monthly = wide.groupBy("site", F.month("ts").alias("_m")).agg(F.max("ts").alias("ts"), *[e for p in params for e in (
        F.max_by(p, "ts").alias(f"last_{p}"), F.sum(known[p]).alias(f"_s_{p}"), F.count(known[p]).alias(f"_c_{p}"))])
    return monthly.groupBy("site").agg(F.max("ts").alias("ts"), *[e for p in params for e in (
        F.max_by(f"last_{p}", "ts").alias(f"last_{p}"),
        F.try_divide(F.sum(f"_s_{p}"), F.sum(f"_c_{p}")).alias(f"train_mean_{p}"),
        F.map_from_entries(F.collect_list(F.struct("_m", F.try_divide(f"_s_{p}", f"_c_{p}")))).alias(f"clim_{p}"))])


def weighted_column(weights: DataFrame, models: list[str], keys: list[str]) -> tuple[DataFrame, object]:
    """Per-key weight table pivoted wide (one row per key) and the blend expression
    ``sum(w_m * m)`` over the members present on the row."""
    ww = weights.groupBy(*keys).pivot("model", models).agg(F.first("weight"))
    ww = ww.select(*keys, *[F.col(m).alias(f"_w_{m}") for m in models])
    terms = [F.coalesce(F.col(f"_w_{m}") * F.col(m), F.lit(0.0)) for m in models]
    return ww, sum(terms[1:], terms[0])
