"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from seriescast.plans import catalog, oracle
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()
FAST = ["src_observations_long", "src5_forecast_calendar", "src5_calendar_gap_fill", "wn14_interpolate",
        "wn01_rolling_mean", "wn02_rolling_std", "wn04_rolling_skew", "wn05_rolling_kurt", "wn07_lags",
        "wn10_pct_change", "wn12_13_ewm", "wn17_18_spells", "ag24_wn19_seasonal", "wn01_hourly_rolling",
        "cal_features", "ph_features", "ag01_07_metrics", "tier1_matrix", "tier2_matrix",
        "ag15_19_breakdown_by_param", "ag20_ratio_histogram", "ag23_cv_summary", "ml13_ridge_stack", "ml14_time_folds", "ml12_contiguous_folds",
        "ml01_standard_scale", "ml02_robust_scale", "src1_daily_csv", "src2_predictions_csv", "snk4_variance_csv",
        "ml15_cv_stack", "ml03_boosted_tree", "ag14_15_range_breakdown", "ag16_17_range_shares"]


def _canon(df):
    df = df[sorted(df.columns)]
    out = []
    for rec in df.itertuples(index=False):
        out.append("|".join("NULL" if v is None or (isinstance(v, float) and v != v)
                            else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in rec))
    return sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


ROWS_ONLY = {"ml03_06_tier1_models", "ml06_random_cut_forest", "ml17_forecast_models"}


def test_every_query_has_an_oracle_except_mllib():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.registry()) <= set(entry.queries())
    assert set(catalog.registry()) - set(oracle.registry()) == ROWS_ONLY


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _canon(got) == _canon(exp)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert {r["param"] for r in rows} == set(__import__("seriescast.config", fromlist=["PARAMS"]).PARAMS)
