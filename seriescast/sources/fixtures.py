"""Site series derived from the driver's tables (``/root/testdata/sf*/``).

The driver's tables hold no weather, so measurement-shaped series are derived
from them by Spark, with the same arithmetic written again in the DuckDB
oracle SQL.  Base sums are rounded when the series is built (double sums
depend on the summation order); everything after that is plain IEEE
arithmetic that both engines evaluate identically.

* ``grain='supp'``: one site per ``l_suppkey`` (sites grow with the scale
  factor); ``grain='flag'``: one site per ``l_returnflag`` (3 long series).
* Ten parameters named as in the reference, affine maps of the day's
  lineitem aggregates into plausible ranges.
* Sentinel -999 on parameter ``i`` where ``pmod(days since 1995-01-01 + i, 13) = 0``.
* Train / test cut: ``ts < 2000-01-01`` is train.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.config import PARAMS, SENTINEL
from seriescast.operators.series import Series, spread

TEST_START = "2000-01-01"
DAY0 = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_col(grain: str = "supp") -> Column:
    return F.col("l_suppkey").cast("string") if grain == "supp" else F.col("l_returnflag")


def _weather(cnt: Column, qty: Column, price: Column, dsum: Column, tsum: Column) -> dict[str, Column]:
    """Square roots and long constants keep the series off decimal grids, so that
    window statistics of both engines never sit on a rounding tie."""
    disc = dsum / cnt
    tax = tsum / cnt
    allsky = F.sqrt(qty / cnt) * 0.91372941 + 0.3119537
    clear = allsky + 1.7320508 + F.sqrt(cnt) * 0.1414213
    return {
        "ALLSKY_SFC_SW_DWN": allsky,
        "ALLSKY_SFC_SW_DNI": F.sqrt(price / cnt) * 0.0312873,
        "ALLSKY_SFC_SW_DIFF": F.sqrt(cnt) * 0.4817293 + 0.2236068,
        "CLRSKY_SFC_SW_DWN": clear,
        "T2M": F.sqrt(tax) * 123.456789 - 4.9137,
        "RH2M": F.sqrt(disc) * 285.71429 + 5.1371,
        "WS2M": F.abs(F.sqrt(disc) - F.sqrt(tax)) * 37.947332,
        "PRECTOTCORR": F.when(disc > 0.05, F.sqrt(disc - 0.05) * 89.442719).otherwise(F.lit(0.0)),
        "PS": F.sqrt(tax) * 56.568542 + 84.9137,
        "ALLSKY_KT": allsky / clear,
    }


def observations_wide(spark: SparkSession, sf_dir: str, grain: str = "supp",
                      sentinels: bool = True, s: Series | None = None) -> DataFrame:
    """``site string, ts date, <10 params> double`` with -999 sentinels.

    With ``s`` the rows are dealt out by site and time bucket (by site where ``s.whole``) before they are summed, so
    that numbering and filling find them there; ``_tb`` is added, and rows without a site are left out."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select(site_col(grain).alias("site"), F.to_date(F.col("l_shipdate")).alias("ts"),
                   "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    keys = ["site", "ts"]
    if s is not None and s.whole:
        li = spread(li.dropna(subset=["site"]), s, "site")
    elif s is not None:
        keys.append("_tb")
        li = spread(li.withColumn("_tb", s.bucket_col()).dropna(subset=["site"]), s, "site", "_tb")
    agg = (li.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("cnt"),
                  F.sum("l_quantity").alias("qty"),
                  F.round(F.sum("l_extendedprice"), 2).alias("price"),
                  F.round(F.sum("l_discount"), 2).alias("dsum"),
                  F.round(F.sum("l_tax"), 2).alias("tsum")))
    w = _weather(F.col("cnt"), F.col("qty"), F.col("price"), F.col("dsum"), F.col("tsum"))
    dn = F.datediff(F.col("ts"), F.lit(DAY0).cast("date"))
    cols = []
    for i, p in enumerate(PARAMS):
        v = w[p]
        if sentinels:
            v = F.when(F.pmod(dn + i, F.lit(13)) == 0, F.lit(SENTINEL)).otherwise(v)
        cols.append(v.alias(p))
    if s is not None and s.whole:
        keys.append(s.bucket_col().alias("_tb"))
    return agg.select(*keys, *cols)


def observations_long(spark: SparkSession, sf_dir: str, grain: str = "supp",
                      sentinels: bool = True) -> DataFrame:
    """``site, ts, param, value`` (PRJ13: unpivot of the wide frame)."""
    wide = observations_wide(spark, sf_dir, grain, sentinels)
    return wide.unpivot(["site", "ts"], PARAMS, "param", "value")


def priority_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and day: ``site, ts, value`` (value = rounded total price).

    Days without orders are absent, not null; ``calendar_fill`` turns them into
    null rows so that interpolation sees real gaps.
    """
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("site"),
                      F.to_date("o_orderdate").alias("ts"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("value")))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour: ``site, ts (timestamp), param, value``
    (value = square root of the hour's rounded value sum)."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("event_type").alias("site"),
                      F.date_trunc("hour", F.col("ts")).alias("ts"))
             .agg(F.sqrt(F.round(F.sum("value"), 2)).alias("value"))
             .withColumn("param", F.lit("value_sum")))


def split_col(ts: str = "ts") -> Column:
    return F.when(F.col(ts) < F.lit(TEST_START).cast("date"), F.lit("train")).otherwise(F.lit("test"))
