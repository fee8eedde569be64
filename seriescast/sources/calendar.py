"""Calendar generators (SRC5) and the calendar join that exposes missing days.

A calendar is generated per series from two dates only (first and last day),
so the driver never sees rows.  Spans are cut by year first and the yearly
chunks are repartitioned before the day-level explode, so a long span is
spread over tasks instead of being exploded by the task that holds its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar_between(bounds: DataFrame, keys: list[str], start: str = "start",
                     end: str = "end", ts: str = "ts", carry: list[str] | None = None) -> DataFrame:
    """Rows ``keys + carry + [ts]`` for every day in ``[start, end]`` of every bounds row."""
    carry = carry or []
    years = bounds.select(*keys, *carry, start, end,
                          F.explode(F.sequence(F.year(start), F.year(end))).alias("_y"))
    years = years.repartition(*keys, "_y")
    lo = F.greatest(F.col(start), F.make_date(F.col("_y"), F.lit(1), F.lit(1)))
    hi = F.least(F.col(end), F.make_date(F.col("_y"), F.lit(12), F.lit(31)))
    return years.select(*keys, *carry, F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias(ts))


def series_calendar(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Every day between each series' first and last day."""
    bounds = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    return calendar_between(bounds, keys, ts=ts)


def calendar_fill(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Left join of the series calendar with ``df``: missing days become null rows."""
    cal = series_calendar(df, keys, ts)
    return cal.join(df, keys + [ts], "left")


def forecast_calendar(df: DataFrame, keys: list[str], ts: str = "ts", carry: list[str] | None = None) -> DataFrame:
    """SRC5 as the reference uses it: all days of the year after each series' last day,
    with the ``YEAR, MO, DY`` parts and the last day's columns ``carry``."""
    carry = carry or []
    nxt = df.groupBy(*keys).agg((F.year(F.max(ts)) + 1).alias("_fy"), *[F.max_by(c, ts).alias(c) for c in carry])
    bounds = nxt.select(*keys, *carry, F.make_date("_fy", F.lit(1), F.lit(1)).alias("start"),
                        F.make_date("_fy", F.lit(12), F.lit(31)).alias("end"))
    cal = calendar_between(bounds, keys, ts=ts, carry=carry)
    return cal.withColumns({"YEAR": F.year(ts), "MO": F.month(ts), "DY": F.dayofmonth(ts)})
