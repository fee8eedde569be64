"""Series of one frame's columns, dealt out as site days: same results as the long form, and plans whose
shuffles carry site days and persist no rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriescast.config import PARAMS
from seriescast.operators import ensemble as E
from seriescast.operators import histtrees as H
from seriescast.operators import rolling as R
from seriescast.operators.ewm import ewm
from seriescast.operators.fill import interpolate, sweep
from seriescast.operators.seasonal import seasonal_means
from seriescast.operators.series import TASK_ROWS, Series, index_neighbours, index_rows, neighbours, spread, task_parts, with_halo
from seriescast.operators.spells import spells
from seriescast.plans import catalog
from seriescast.plans import evaluate as EV
from tests.conftest import SF_SMALL

LONG = Series(block_rows=32)
DAYS = Series(keys=("site",), dealt=("site",), block_rows=32)


def _days(spark, sites=3, n=400):
    rnd = random.Random(5)
    rows = [(f"s{i}", dt.date(1998, 11, 1) + dt.timedelta(days=2 * d),
             *[None if rnd.random() < 0.3 else float(rnd.choice([0, 1, 2.5, 7])) for _ in range(2)])
            for i in range(sites) for d in range(n)]
    rows += [(None, dt.date(1999, 1, 1), 1.0, 2.0), ("s0", None, 1.0, 2.0), ("none", dt.date(1999, 1, 1), None, None)]
    return spark.createDataFrame(rows, "site string, ts date, a double, b double")


def _long(wide):
    return EV.by_param(wide, ["a", "b"])


def _rows(df, *cols):
    return sorted(df.select(*cols).collect(), key=lambda r: tuple(str(x) for x in r[:3]))


def _blocked(wide, halo=0, block_rows=32):
    s = DAYS.with_blocks(block_rows)
    d = interpolate(wide, s, ["a", "b"])
    return _long(EV.blocked_days(d, s, halo)), s.with_keys("site", "param")


def _cleaned(wide):
    return interpolate(index_rows(_long(wide), LONG), LONG)


def test_index_neighbours_is_numbering_then_carries(spark):
    d = _days(spark)
    old = neighbours(index_rows(d, DAYS), DAYS, ["a", "b"])
    cols = ["site", "ts", "rn", "n", "_prev_a", "_next_a", "_prev_b", "_next_b"]
    assert _rows(index_neighbours(d, DAYS, ["a", "b"]), *cols) == _rows(old, *cols)


def test_filled_batches_are_the_windows_rows(spark):
    d = _days(spark).union(spark.createDataFrame([("s1", dt.date(1998, 10, 1), None, float("nan")), ("s0", None, None, None)], "site string, ts date, a double, b double"))
    want = repr(_rows(interpolate(index_rows(d, DAYS), DAYS, ["b"]), "site", "ts", "b", "n", "rn"))
    for rows in ("10000", "7"):     # buckets cut by batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = interpolate(d, DAYS, ["b"])
            assert got.columns == ["site", "ts", "a", "b", "_tb", "n", "rn"]
            assert repr(_rows(got, "site", "ts", "b", "n", "rn")) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filling_shuffles_the_site_days_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        days = EV.days_series(spark, SF_SMALL)
        plan = EV.candidates_wide(EV.cleaned_days(spark, SF_SMALL, days), days)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1


def test_blocked_series_give_the_long_forms_rows(spark):
    d = _days(spark)
    flat = _cleaned(d)
    pct = [{"p": R.pct_change("value", 3), "m": R.mean("value", 7)}]
    b, s = _blocked(d, 8)
    cols = ["site", "param", "ts", "p", "m"]
    assert _rows(sweep(R.trailing(b, s, pct, halo=8), s, ["p"]), *cols) == _rows(
        sweep(R.trailing(flat, LONG, pct, halo=8), LONG, ["p"]), *cols)
    b, s = _blocked(d)
    cols = ["site", "param", "ts", "dry_spell_length", "wet_spell_length"]
    assert _rows(spells(b, s), *cols) == _rows(spells(flat, LONG), *cols)
    cols = ["site", "param", "ts", "v_ewm_7", "v_ewm_std_7"]
    for x, y in zip(_rows(ewm(b, s, [7], prefix="v"), *cols), _rows(ewm(flat, LONG, [7], prefix="v", block_rows=32), *cols), strict=True):
        assert x[:3] == y[:3] and list(x[3:]) == pytest.approx(list(y[3:]), nan_ok=True)


WHOLE = Series(keys=("site",), dealt=("site",), whole=True)


def test_whole_series_give_the_rows_of_blocks(spark):
    d = _days(spark).union(spark.createDataFrame([("s1", dt.date(1998, 10, 1), None, float("nan")), ("s0", None, None, None)], "site string, ts date, a double, b double"))
    cols = ["site", "ts", "a", "b", "n", "rn"]
    got = interpolate(d, WHOLE, ["a", "b"])
    want = interpolate(d, DAYS, ["a", "b"])
    assert got.columns == want.columns
    assert repr(_rows(got, *cols)) == repr(_rows(want, *cols))
    stage = [{"p": R.pct_change("value", 3), "l": R.lag_bfill("value", 9), "x": R.vmax("value", 40)}]

    def swept(s):
        b = _long(EV.blocked_days(interpolate(_days(spark), s, ["a", "b"]), s, 40))
        by = s.with_keys("site", "param")
        return spells(sweep(R.trailing(b, by, stage, halo=40), by, ["p"]), by)
    cols = ["site", "param", "ts", "p", "l", "x", "dry_spell_length", "wet_spell_length"]
    assert _rows(swept(WHOLE), *cols) == _rows(swept(DAYS), *cols)
    some = _days(spark).where("site IS NOT NULL AND ts IS NOT NULL").select("site", "ts", F.col("a").alias(PARAMS[0]), F.col("b").alias(PARAMS[1]))
    for name in ("seasons", "candidates"):
        got, want = [], []
        for s, to in ((WHOLE, got), (DAYS, want)):
            w = interpolate(some, s, PARAMS[:2])
            x = seasonal_means(w, s, cols=PARAMS[:2]) if name == "seasons" else EV.candidates_wide(w, s, PARAMS[:2])
            to += _rows(x, *sorted(set(x.columns) - {"_tb"}, key=lambda c: (c not in ("site", "param", "ts"), c)))
        for x, y in zip(got, want, strict=True):
            assert [v if not isinstance(v, float) else pytest.approx(v, nan_ok=True) for v in y] == list(x)


@pytest.mark.parametrize("name", ["ag24_wn19_seasonal", "ml07_fixed_blend", "ph_features", "wn01_rolling_mean", "wn02_rolling_std",
                                  "wn03_rolling_min_max"])
def test_whole_sites_are_shuffled_once(spark, name, monkeypatch):
    monkeypatch.setattr(EV, "task_parts", lambda spark, rows: 13)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(catalog, f"q_{name}")(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "param" not in x.split("Exchange")[1]]
    assert len(rows) == 1, rows


def test_a_site_over_a_tasks_share_is_cut(spark, monkeypatch):
    assert EV.days_series(spark, SF_SMALL).whole and not EV.days_series(spark, SF_SMALL, whole=False).whole
    want = {r["site"]: r["c"] for r in EV.cleaned(spark, SF_SMALL).groupBy("site").agg(F.count("value").alias("c")).collect()}
    monkeypatch.setattr(EV, "TASK_ROWS", 10)
    assert not EV.days_series(spark, SF_SMALL).whole
    assert {r["site"]: r["c"] for r in EV.cleaned(spark, SF_SMALL).groupBy("site").agg(F.count("value").alias("c")).collect()} == want


def test_weights_read_the_rows_once(spark):
    rows = [("a", "x", 1.0, 1.5), ("a", "x", 3.0, 2.5), ("a", "y", 1.0, 1.1), ("a", "y", 3.0, 3.2), (None, "x", 1.0, 1.0),
            ("b", "x", 1.0, 9.0), ("b", "x", 2.0, 7.0)]
    w = E.r2_weights(spark.createDataFrame(rows, "param string, model string, actual double, predicted double"), ["param"], ["x", "y"])
    got = {(r["param"], r["model"]): r["weight"] for r in w.collect()}
    x, y = 1 - 0.5 / 2, 1 - 0.05 / 2
    assert got == {("a", "x"): pytest.approx(x / (x + y)), ("a", "y"): pytest.approx(y / (x + y)), ("b", "x"): pytest.approx(1.0)}
    assert w._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_chosen_rows_are_the_chosen_models_rows(spark):
    cols = ["site", "param", "ts", "model", "actual", "predicted", "train_mean"]
    got = catalog._chosen(spark, SF_SMALL)
    pick = {r["param"]: r["model"] for r in got.select("param", "model").distinct().collect()}
    assert len(pick) == len(PARAMS)
    every = catalog._all_models(spark, SF_SMALL)
    want = [r for r in every.select(*cols).collect() if pick[r["param"]] == r["model"]]
    assert _rows(got, *cols) == sorted(want, key=lambda r: tuple(str(x) for x in r[:3]))
    assert got._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0].count("Generate explode") == 1


def test_seasons_of_several_columns(spark):
    d = _days(spark).where("site IS NOT NULL AND ts IS NOT NULL")
    got = EV.by_param(seasonal_means(d, DAYS, cols=["a", "b"]), ["a", "b"],
                      {"value": "{p}", **{c: "{p}" + c for c in ("_yearly_avg", "_deviation_from_monthly")}})
    want = seasonal_means(_long(d), LONG, prefix="")
    cols = ["site", "param", "ts", "_yearly_avg", "_deviation_from_monthly"]
    for x, y in zip(_rows(got, *cols), _rows(want, *cols), strict=True):
        assert x[:3] == y[:3] and list(x[3:]) == pytest.approx(list(y[3:]))


def test_fixed_blend_of_columns_is_the_long_blend(spark):
    w = spark.createDataFrame([(1, 2.0, 3.0, 4.0), (2, 1.0, None, 4.0)], "id int, actual double, x double, y double")
    long = EV.to_long(w.withColumn("train_mean", F.lit(0.0)), ["x", "y"], ["id"])
    blend = {"x": 0.6, "y": 0.4}
    cols = ["id", "model", "predicted"]
    assert _rows(E.fixed_blend(w, blend), *cols) == _rows(E.fixed_blend(long, blend), *cols)
    assert E.fixed_blend(w, blend).count() == 1


def test_trees_hold_the_rows_once(spark, monkeypatch):
    """Nothing is written to the checkpoint folder, and cuts and means are read in one pass."""
    wide, feats, held = catalog._yesterday(spark, SF_SMALL, hold=True)
    settings = H.TreeSettings(trees=1, depth=2, rate=0.05, l1=0.05, l2=1.0, bins=16, cuts="width")
    want = H.fit_boosted(wide, feats, PARAMS, ["site", "ts"], settings)
    frame, passes = type(wide), []
    monkeypatch.setattr(frame, "checkpoint", lambda *a, **k: pytest.fail("a copy of the rows"))
    first = frame.first
    monkeypatch.setattr(frame, "first", lambda self: passes.append(1) or first(self))
    got = H.fit_boosted(wide, feats, PARAMS, ["site", "ts"], settings, reread=True)
    assert len(passes) == 1
    assert held.is_cached
    assert [(t.target, t.feature, t.cut, t.weight) for t in got.trees] == [(t.target, t.feature, t.cut, t.weight) for t in want.trees]
    again = wide.agg(F.max(feats[0]))
    again.collect()
    rows = again._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in rows      # yesterday is read where the held days lie


@pytest.mark.parametrize("name", ["ml09_ml11_choice_orders", "ml10_model_choice"])
def test_weights_and_choice_read_one_shuffle_and_persist_no_rows(spark, name):
    spark.catalog.clearCache()
    d = catalog._all_models(spark, SF_SMALL)
    assert "InMemory" not in d._jdf.queryExecution().optimizedPlan().toString()
    d = getattr(catalog, f"q_{name}")(spark, SF_SMALL)
    assert "ts#" not in "".join(x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "InMemoryRelation" in x)


def test_ridge_reads_the_rows_once(spark):
    """As sums of products about the columns' means, also where columns miss different rows."""
    rnd = random.Random(3)
    rows = [("p" if i % 2 else "q", *[None if rnd.random() < 0.1 else 1e6 + rnd.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    pred = spark.createDataFrame([*rows, (None, 1.0, 2.0, 3.0)], "param string, x double, y double, actual double")
    fitted = E.ridge_fit(pred, ["param"], ["x", "y"])
    assert "InMemory" not in fitted._jdf.queryExecution().optimizedPlan().toString()
    got = {r["param"]: list(r)[1:] for r in fitted.collect()}
    assert set(got) == {"p", "q"}
    for p in got:
        cols = list(zip(*[r[1:] for r in rows if r[0] == p]))
        mean = [sum(v for v in c if v is not None) / sum(v is not None for v in c) for c in cols]
        prod = [[sum((u - mean[i]) * (v - mean[j]) for u, v in zip(cols[i], cols[j]) if u is not None and v is not None)
                 for j in range(3)] for i in range(3)]
        a, b, c = prod[0][0] + 1, prod[0][1], prod[1][1] + 1
        w = [(prod[0][2] * c - b * prod[1][2]) / (a * c - b * b), (a * prod[1][2] - b * prod[0][2]) / (a * c - b * b)]
        assert got[p] == pytest.approx([mean[2] - mean[0] * w[0] - mean[1] * w[1], *w], rel=1e-6)


def test_robust_scale_holds_site_days_once(spark):
    spark.catalog.clearCache()
    plan = catalog.q_ml02_robust_scale(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2      # the site days and the fitted table


def test_a_tasks_share_is_small(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert task_parts(spark, 36_000_000) == max(720, least)


def test_tasks_grow_with_the_rows(spark):
    assert task_parts(spark, 1000) is None
    assert task_parts(spark, 100 * TASK_ROWS) == 100
    s = Series(keys=("site",), dealt=("site",), parts=37)
    assert spread(with_halo(index_rows(_days(spark), s), s, 3), s, "site", "_blk").rdd.getNumPartitions() == 37


@pytest.mark.parametrize("name", ["wn01_rolling_mean", "wn10_pct_change", "wn12_13_ewm", "wn17_18_spells", "wn09_pressure_tendency",
                                  "wn14_interpolate", "ag24_wn19_seasonal", "ag01_07_metrics", "ml07_fixed_blend", "er_prediction_errors",
                                  "ph_features", "tier1_matrix"])
def test_rows_are_shuffled_as_site_days_and_not_persisted(spark, name):
    spark.catalog.clearCache()
    plan = getattr(catalog, f"q_{name}")(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "param" in x.split("Exchange")[1]]
    rows = [x for x in wide if "_blk" in x or "_tb" in x or "ts#" in x]
    assert not rows, rows


@pytest.mark.parametrize("name", ["wn10_pct_change", "wn12_13_ewm", "tier1_matrix"])
def test_carries_meet_dealt_rows_where_they_lie(spark, name, monkeypatch):
    # tables too large to be broadcast
    monkeypatch.setattr(EV, "task_parts", lambda spark, rows: 13)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(catalog, f"q_{name}")(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ENSURE" in x and ("_blk" in x or "_tb" in x)]
    assert not again, again


def test_parameters_read_the_same_days(spark):
    days = EV.days_series(spark, SF_SMALL)
    d = EV.cleaned_days(spark, SF_SMALL, days)
    assert d.count() == EV.cleaned(spark, SF_SMALL).count() / len(PARAMS)
