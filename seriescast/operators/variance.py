"""Variance analysis of predictions (AG8-AG10, AG14-AG20, TK1).

Input: long predictions ``param, actual, predicted`` (plus any other keys).
The ratio is ``(a - p) / (p + 1e-10)``.  Every table is a grouped aggregate;
pivots get their value lists up front (no extra job to discover them); the
fixed label and bin grids are exploded from literal arrays (no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.config import PARAMS, RANGE_LABELS, TIGHT_HI, TIGHT_LO
from seriescast.functions.errors import percent_variance, range_label, variance_ratio
from seriescast.operators.quantile import exact_quantiles
from seriescast.operators.series import reused, small_side


def with_ratio(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pred.withColumns({"ratio": variance_ratio(actual, predicted),
                             "pct_variance": percent_variance(actual, predicted)})


def variance_summary(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AG8 + AG9: ``Total_Records, Records_In_Range, Percentage_In_Range`` and the
    mean / exact median / population std / min / max of the ratio."""
    keys = keys or ["param"]
    d = with_ratio(pred)
    r = F.col("ratio")
    inr = (r >= TIGHT_LO) & (r <= TIGHT_HI)
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Total_Records"),
        F.count_if(inr).alias("Records_In_Range"),
        F.avg(r).alias("Mean_Variance"),
        F.stddev_pop(r).alias("Std_Variance"),
        F.min(r).alias("Min_Variance"),
        F.max(r).alias("Max_Variance"),
    ).withColumn("Percentage_In_Range", F.col("Records_In_Range") / F.col("Total_Records") * 100)
    med = exact_quantiles(d, keys, "ratio", [0.5], names=["Median_Variance"])
    out = base.join(med, keys, "left")
    return out.select(*keys, "Total_Records", "Records_In_Range", "Percentage_In_Range",
                      "Mean_Variance", "Median_Variance", "Std_Variance", "Min_Variance", "Max_Variance")


def overall_in_range(summary: DataFrame) -> DataFrame:
    """AG10: one row; points in range over all (rows x parameters)."""
    return summary.agg(F.sum("Total_Records").alias("total_points"),
                       F.sum("Records_In_Range").alias("points_in_range")).withColumn(
        "overall_pct", F.col("points_in_range") / F.col("total_points") * 100)


def range_table(pred: DataFrame) -> DataFrame:
    """AG14-AG19 in one table: per parameter, and for all of them (null ``param``, ``is_total`` 1), the
    rows in each of the six ranges (``c0`` .. ``c5``) and their ``total``.

    One grouped aggregate of conditional counts over the rows; the grand total is the rollup of
    its few rows, not a second grouping of the rows."""
    d = with_ratio(pred).withColumn("_r", range_label("pct_variance"))
    cells = [F.count_if(F.col("_r") == lab).alias(f"c{i}") for i, lab in enumerate(RANGE_LABELS)]
    per = d.groupBy("param").agg(*cells)
    out = per.rollup("param").agg(F.grouping("param").cast("int").alias("is_total"),
                                  *[F.sum(f"c{i}").cast("long").alias(f"c{i}") for i in range(len(cells))])
    return out.withColumn("total", sum((F.col(f"c{i}") for i in range(1, len(cells))), F.col("c0")))


def _ranges(table: DataFrame) -> DataFrame:
    """``range_table`` with one row per range: ``param, is_total, range_order, range, count, total``."""
    cells = F.array(*[F.struct(F.lit(i).alias("range_order"), F.lit(lab).alias("range"), F.col(f"c{i}").alias("count"))
                      for i, lab in enumerate(RANGE_LABELS)])
    return table.select("param", "is_total", "total", F.explode(cells).alias("_c")).select(
        "param", "is_total", "_c.*", "total")


def range_counts(pred: DataFrame) -> DataFrame:
    """Long form of AG14: ``param, range_order, range, count`` for all six ranges (zeros kept)."""
    return _ranges(range_table(pred)).where("is_total = 0").select("param", "range_order", "range", "count")


def range_breakdown(pred: DataFrame, params: list[str] | None = None) -> DataFrame:
    """AG14 + AG15: one row per range, one count column per parameter, plus TOTAL."""
    params = params or PARAMS
    long = _ranges(range_table(pred).where(F.col("param").isin(params) | (F.col("is_total") == 1)))
    wide = long.groupBy("range_order", "range").agg(
        *[F.coalesce(F.max(F.when(F.col("param") == p, F.col("count"))), F.lit(0)).cast("long").alias(p) for p in params])
    total = sum((F.col(f"`{p}`") for p in params[1:]), F.col(f"`{params[0]}`"))
    return wide.withColumn("TOTAL", total)


def range_shares(pred: DataFrame) -> DataFrame:
    """AG16 + AG17: per range, the count over all points and its share of all points;
    then the excellent [-5, 5] / good [-5, 10] / outside groupings as extra rows."""
    good = F.col("c2") + F.col("c3") + F.col("c4")
    rows = [(i, F.lit(lab), F.col(f"c{i}")) for i, lab in enumerate(RANGE_LABELS)]
    rows += [(10, F.lit("excellent -5% to +5%"), F.col("c2") + F.col("c3")),
             (11, F.lit("good -5% to +10%"), good),
             (12, F.lit("outside"), F.col("total") - good)]
    arr = F.array(*[F.struct(F.lit(i).alias("range_order"), lab.alias("range"),
                             v.cast("long").alias("count"),
                             (v / F.col("total") * 100).alias("share_pct")) for i, lab, v in rows])
    return range_table(pred).where("is_total = 1").select(F.explode(arr).alias("r")).select("r.*")


def range_share_by_param(pred: DataFrame) -> DataFrame:
    """AG18: ``param, range, count, pct_of_param`` (column percent of the breakdown)."""
    long = _ranges(range_table(pred)).where("is_total = 0")
    return long.select("param", "range_order", "range", "count",
                       (F.col("count") / F.col("total") * 100).alias("pct_of_param"))


def range_breakdown_by_param(pred: DataFrame) -> DataFrame:
    """AG19: the transposed breakdown, one row per parameter and one column per range, and
    the parameter's own ``TOTAL`` (AG15)."""
    return range_table(pred).where("is_total = 0").select(
        "param", *[F.col(f"c{i}").alias(lab) for i, lab in enumerate(RANGE_LABELS)], F.col("total").alias("TOTAL"))


def histogram(df: DataFrame, keys: list[str], col: str, bins: int = 50) -> DataFrame:
    """AG20: ``bins`` equal bins from min to max per group, last bin closed (numpy's rule,
    including its edge correction); a constant group uses ``[v - 0.5, v + 0.5]``.
    Empty bins are kept."""
    x = reused(df.select(*keys, F.col(col).alias("_x")).where(F.col("_x").isNotNull()))
    rng = x.groupBy(*keys).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    rng = rng.select(*keys,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))
    rng = small_side(rng)
    step = (F.col("hi") - F.col("lo")) / bins

    def edge(i):
        return F.when(i >= bins, F.col("hi")).otherwise(i * step + F.col("lo"))

    d = x.join(rng, keys)
    i0 = F.least(F.greatest(F.floor((F.col("_x") - F.col("lo")) * (bins / (F.col("hi") - F.col("lo")))),
                            F.lit(0)), F.lit(bins - 1)).cast("long")
    d = d.withColumn("_i", i0)
    d = d.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    d = d.withColumn("_i", F.when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    cnt = d.groupBy(*keys, F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumns({"bin_lo": edge(F.col("bin")), "bin_hi": edge(F.col("bin") + 1)})
    out = grid.join(cnt, keys + ["bin"], "left").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))
    return out.select(*keys, F.col("bin").cast("int").alias("bin"), "bin_lo", "bin_hi", "count")


def best_worst(summary: DataFrame, params: list[str] | None = None,
               metric: str = "Percentage_In_Range") -> DataFrame:
    """TK1: best and worst parameter; ties go to the first in parameter order."""
    params = params or PARAMS
    order = F.array_position(F.array(*[F.lit(p) for p in params]), F.col("param"))
    d = summary.withColumn("_ord", order)
    return d.agg(
        F.max_by("param", F.struct(F.col(metric), -F.col("_ord"))).alias("best_param"),
        F.max(metric).alias("best_value"),
        F.min_by("param", F.struct(F.col(metric), F.col("_ord"))).alias("worst_param"),
        F.min(metric).alias("worst_value"),
    )
