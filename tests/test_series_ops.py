"""Blocked series operators against pandas itself (WN1-WN18)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriescast import Series
from seriescast.operators import rolling as R
from seriescast.operators.ewm import ewm, ewm_reference
from seriescast.operators.fill import interpolate, sweep
from seriescast.operators.series import index_rows
from seriescast.operators.spells import spells

S = Series(block_rows=16)


def _frame(spark, series: dict[str, list], start="2020-01-01"):
    rows = []
    for site, vals in series.items():
        days = pd.date_range(start, periods=len(vals), freq="D")
        for d, v in zip(days, vals):
            rows.append((site, "p", d.date(), None if v is None or (isinstance(v, float) and np.isnan(v)) else float(v)))
    return spark.createDataFrame(rows, "site string, param string, ts date, value double")


def _collect(df, cols):
    pdf = df.select("site", "ts", *cols).toPandas().sort_values(["site", "ts"])
    return pdf


def test_interpolate_edges(spark):
    df = _frame(spark, {"a": [-999, -999, 1, -999, -999, 4, -999, -999]})
    df = df.withColumn("value", F.when(F.col("value") == -999, None).otherwise(F.col("value")))
    out = _collect(interpolate(df, Series(block_rows=3)), ["value"])
    assert out["value"].tolist() == [1, 1, 1, 2, 3, 4, 4, 4]


def test_interpolate_matches_pandas_across_blocks(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(10, 3, 200)
    vals[rng.random(200) < 0.3] = np.nan
    vals[:5] = np.nan
    vals[-7:] = np.nan
    df = _frame(spark, {"a": vals.tolist(), "b": [np.nan] * 10})
    out = _collect(interpolate(df, Series(block_rows=7)), ["value"])
    exp = pd.Series(vals).interpolate(method="linear").bfill().ffill()
    got = out[out.site == "a"]["value"].to_numpy()
    np.testing.assert_allclose(got, exp.to_numpy(), rtol=0, atol=1e-12)
    assert out[out.site == "b"]["value"].isna().all()


def test_rolling_lags_diffs_match_pandas(spark):
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(5, 2, 300).round(3).tolist(), "b": rng.normal(0, 1, 40).round(3).tolist()}
    series["a"][50:60] = [7.0] * 10  # constant window
    df = _frame(spark, series)
    exprs = {}
    exprs.update(R.rolling_stats("value", [3, 7, 30], ("mean", "std", "min", "max", "sum", "skew", "kurt")))
    exprs.update({f"lag_{k}": R.lag_bfill("value", k) for k in (1, 7, 60)})
    exprs.update({f"diff_{k}": R.diff("value", k) for k in (1, 7)})
    exprs.update({f"pct_{k}": R.pct_change("value", k) for k in (1, 2)})
    stage2 = {"diff_rolling_7": R.mean("diff_1", 7)}
    out = R.trailing(index_rows(df, S), S, [exprs, stage2], halo=70, block_rows=16)
    out = _collect(out, list(exprs) + list(stage2))
    for site, vals in series.items():
        s = pd.Series(vals)
        got = out[out.site == site].reset_index(drop=True)
        for k in (3, 7, 30):
            r = s.rolling(k, min_periods=1)
            np.testing.assert_allclose(got[f"value_rolling_{k}"], r.mean(), atol=1e-9)
            np.testing.assert_allclose(got[f"value_rolling_std_{k}"], r.std().fillna(0), atol=1e-9)
            np.testing.assert_allclose(got[f"value_rolling_min_{k}"], r.min(), atol=1e-12)
            np.testing.assert_allclose(got[f"value_rolling_max_{k}"], r.max(), atol=1e-12)
            np.testing.assert_allclose(got[f"value_rolling_sum_{k}"], r.sum(), atol=1e-9)
            if k >= 7:
                np.testing.assert_allclose(got[f"value_rolling_skew_{k}"],
                                           s.rolling(k, min_periods=3).skew().fillna(0), atol=1e-6)
                np.testing.assert_allclose(got[f"value_rolling_kurt_{k}"],
                                           s.rolling(k, min_periods=4).kurt().fillna(0), atol=1e-5)
        for k in (1, 7, 60):
            exp = s.shift(k).bfill()
            np.testing.assert_allclose(got[f"lag_{k}"].astype(float), exp, atol=0)
        for k in (1, 7):
            np.testing.assert_allclose(got[f"diff_{k}"], s.diff(k).fillna(0), atol=1e-12)
        np.testing.assert_allclose(got["diff_rolling_7"], s.diff(1).fillna(0).rolling(7, min_periods=1).mean(), atol=1e-9)


def test_pct_change_and_sweep(spark):
    vals = [0.0, 0, 5, 0, 0, 3, 0, 1, 2, 0]
    df = _frame(spark, {"a": vals})
    d = R.trailing(index_rows(df, S), S, [{"pct_1": R.pct_change("value", 1)}], halo=3, block_rows=4)
    d = sweep(d, Series(block_rows=4), ["pct_1"])
    got = _collect(d, ["pct_1"])["pct_1"].tolist()
    exp = pd.Series(vals).pct_change(1).fillna(0).replace([np.inf, -np.inf], np.nan).bfill().ffill().fillna(0)
    assert got == exp.tolist()


@pytest.mark.parametrize("span", [7, 30, 60])
def test_ewm_block_scan(spark, span):
    rng = np.random.default_rng(span)
    vals = (rng.normal(100, 5, 700)).tolist()
    df = _frame(spark, {"a": vals, "b": vals[:3]})
    out = _collect(ewm(index_rows(df, S), S, [span], block_rows=32), [f"value_ewm_{span}", f"value_ewm_std_{span}"])
    for site, v in (("a", vals), ("b", vals[:3])):
        got = out[out.site == site]
        s = pd.Series(v)
        np.testing.assert_allclose(got[f"value_ewm_{span}"], s.ewm(span=span, adjust=False).mean(), rtol=1e-11)
        np.testing.assert_allclose(got[f"value_ewm_std_{span}"], s.ewm(span=span, adjust=False).std().fillna(0),
                                   rtol=1e-8, atol=1e-9)
        m, sd = ewm_reference(v, span)
        np.testing.assert_allclose(got[f"value_ewm_{span}"], m, rtol=1e-11)


def test_spells(spark):
    rain = [0, 0, 5, 0, 0, 0, 2, 3, 0]
    df = _frame(spark, {"a": rain})
    got = _collect(spells(df, Series(block_rows=2)), ["dry_spell_length", "wet_spell_length"])
    assert got["dry_spell_length"].tolist() == [1, 2, 0, 1, 2, 3, 0, 0, 1]
    assert got["wet_spell_length"].tolist() == [0, 0, 1, 0, 0, 0, 1, 2, 0]


def test_index_rows_many_buckets(spark):
    df = _frame(spark, {"a": list(range(800)), "b": list(range(5))}, start="2019-12-25")
    out = index_rows(df, S).select("site", "ts", "rn", "n").toPandas().sort_values(["site", "ts"])
    for site, g in out.groupby("site"):
        assert g["rn"].tolist() == list(range(1, len(g) + 1))
        assert (g["n"] == len(g)).all()


def test_moment_stages_match_pandas(spark):
    rng = np.random.default_rng(11)
    vals = (rng.normal(50, 4, 400)).round(2).tolist()
    vals[100:115] = [51.0] * 15          # constant frames
    vals[200:260] = [x + 30 for x in vals[200:260]]   # level shift inside a block
    df = _frame(spark, {"a": vals, "b": vals[:5]})
    stages = R.moment_stages("value", [7, 30, 90], prefix="v")
    out = R.trailing(index_rows(df, S), S, stages, halo=90, block_rows=64)
    names = list(stages[-1])
    got = _collect(out, names)
    assert not any(c.startswith("__") for c in out.columns)
    for site, v in (("a", vals), ("b", vals[:5])):
        s = pd.Series(v)
        g = got[got.site == site]
        for k in (7, 30, 90):
            np.testing.assert_allclose(g[f"v_rolling_skew_{k}"], s.rolling(k, min_periods=3).skew().fillna(0),
                                       atol=1e-7)
            np.testing.assert_allclose(g[f"v_rolling_kurt_{k}"], s.rolling(k, min_periods=4).kurt().fillna(0),
                                       atol=1e-6)


def test_moments_survive_a_storm(spark):
    """Rain-like series with two storms, one block of 4,096 rows: no window near a storm loses digits."""
    rng = np.random.default_rng(5)
    v = np.where(rng.random(4000) < 0.2, rng.gamma(0.6, 6.0, 4000), 0.0) + rng.random(4000) * 0.05
    v[1200], v[2600] = 180.0, 240.0
    stages = R.moment_stages("value", [7, 14], prefix="v")
    out = R.trailing(index_rows(_frame(spark, {"a": v.tolist()}), Series()), Series(), stages, halo=14)
    got = _collect(out, list(stages[-1]))
    s = pd.Series(v)
    for k in (7, 14):
        m = s.rolling(k).apply(lambda w: pd.Series(w - w.mean()).kurt(), raw=True)[k:]
        np.testing.assert_allclose(got[f"v_rolling_kurt_{k}"].to_numpy()[k:], m, atol=1e-3)
        m = s.rolling(k).apply(lambda w: pd.Series(w - w.mean()).skew(), raw=True)[k:]
        np.testing.assert_allclose(got[f"v_rolling_skew_{k}"].to_numpy()[k:], m, atol=1e-4)
