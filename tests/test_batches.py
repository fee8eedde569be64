"""Whole series as Arrow batches: the rows of the windows, in one pass without windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriescast.config import PARAMS
from seriescast.operators import rolling as R
from seriescast.operators.ewm import ewm_reference, ewm_stage
from seriescast.operators.fill import interpolate
from seriescast.operators.series import Series
from seriescast.plans import catalog
from seriescast.plans import evaluate as EV
from seriescast.plans.features import build_matrix
from seriescast.plans.tiers import TIERS
from tests.conftest import SF_SMALL

WHOLE = Series(keys=("site",), dealt=("site",), whole=True)
BATCHES = Series(keys=("site",), dealt=("site",), whole=True, batches=True)
STAGES = [{**R.rolling_stats("value", [3, 7, 14, 30], ("mean", "std", "min", "max", "sum", "skew", "kurt"), "_v"),
           "_l": R.lag_bfill("value", 9), "_l0": R.lag_bfill("value", 500, or0=True), "_d": R.diff("value", 2), "_dn": R.diff("value", 3, fill0=False)},
          {"_r": R.mean("_d", 7)}]
NAMES = [n for stage in STAGES for n in stage]


def _days(spark, sites=3, n=200):
    rnd = random.Random(5)
    rows = [(f"s{i}", dt.date(1998, 11, 1) + dt.timedelta(days=2 * d),
             *[None if rnd.random() < 0.3 else float(rnd.choice([0, 1, 2.5, 7])) for _ in range(2)])
            for i in range(sites) for d in range(n)]
    rows += [(None, dt.date(1999, 1, 1), 1.0, 2.0), ("s0", None, 1.0, 2.0), ("s1", None, None, 3.0), ("none", dt.date(1999, 1, 1), None, None),
             ("one", dt.date(1999, 1, 1), 4.0, None), ("one", dt.date(1999, 1, 2), None, None)]
    return spark.createDataFrame(rows, "site string, ts date, a double, b double").repartition(3, "site")


def _rows(df, *cols):
    return sorted(([*r] for r in df.select(*cols).collect()), key=lambda r: tuple(str(x) for x in r[:3]))


@pytest.fixture(params=["10000", "7"])      # 7: series are cut by batches
def arrow(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filled_batches_of_whole_series(arrow):
    d, cols = _days(arrow), ["site", "ts", "a", "b", "n", "rn"]
    got, want = interpolate(d, BATCHES, ["a", "b"]), interpolate(d, WHOLE, ["a", "b"])
    assert got.columns == want.columns
    assert repr(_rows(got, *cols)) == repr(_rows(want, *cols))


def test_trailing_batches_are_the_windows_rows(arrow):
    d = _days(arrow)
    flat = EV.by_param(EV.blocked_days(interpolate(d, WHOLE, ["a", "b"]), WHOLE, 90), ["a", "b"])
    want = _rows(R.trailing(flat, WHOLE.with_keys("site", "param"), STAGES, halo=90), "site", "param", "ts", *NAMES)
    filled = interpolate(d, BATCHES, ["a", "b"])
    got = _rows(R.trailing_days(filled, BATCHES, STAGES, ["a", "b"], long=True), "site", "param", "ts", *NAMES)
    beside = R.trailing_days(filled, BATCHES, STAGES, ["a", "b"])
    beside = _rows(EV.by_param(beside, ["a", "b"], {n: "{p}" + n for n in NAMES}), "site", "param", "ts", *NAMES)
    assert len(got) == len(want) == 2 * 603
    assert repr(beside) == repr(got)
    for x, y in zip(got, want, strict=True):
        assert x[:3] == y[:3] and [v is None for v in x] == [v is None for v in y]
        assert x[3:] == [v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in y[3:]]


def test_ewm_batches_are_the_recursion(arrow):
    filled = interpolate(_days(arrow), BATCHES, ["a", "b"])
    got = _rows(R.trailing_days(filled, BATCHES, [ewm_stage([1, 7, 60])], ["a", "b"], long=True), "param", "site", "ts",
                *[f"_ewm{x}_{k}" for k in (1, 7, 60) for x in ("", "_std")])
    values = {(p, r["site"], r["ts"]): r[p] for r in filled.collect() for p in "ab"}
    series = {}
    for r in got:
        series.setdefault((r[0], r[1]), []).append(r)
    for (p, site), rows in series.items():
        x = [values[p, site, r[2]] for r in rows]
        if x[0] is None:
            assert all(r[3:] == [None, 0.0] * 3 for r in rows)
            continue
        for i, span in enumerate((1, 7, 60)):
            means, stds = ewm_reference(x, span)
            assert [r[3 + 2 * i] for r in rows] == pytest.approx(means, abs=1e-9)
            assert [r[4 + 2 * i] for r in rows] == pytest.approx(stds, abs=1e-7)


def test_series_out_of_order_fail(spark):
    filled = interpolate(_days(spark), BATCHES, ["a", "b"]).localCheckpoint()
    with pytest.raises(Exception, match="whole and in order"):
        R.trailing_days(filled.orderBy(F.col("rn").desc()), BATCHES, STAGES, ["a", "b"]).collect()


@pytest.mark.parametrize("tier", [1, 2, 3])
def test_matrix_of_batches_is_the_pivoted_one(spark, tier):
    t, rnd = TIERS[tier], random.Random(2)
    rows = [(f"s{i}", dt.date(1999, 10, 1) + dt.timedelta(days=d), *[rnd.gauss(10, 3) for _ in PARAMS]) for i in range(2) for d in range(150)]
    days = spark.createDataFrame(rows, ["site", "ts", *PARAMS]).withColumn("split", EV.split_col("ts"))
    want, names = build_matrix(days.unpivot(["site", "split", "ts"], PARAMS, "param", "value"), t)
    s = BATCHES.with_keys("site", "split")
    got, same = build_matrix(interpolate(days.repartition("site"), s, PARAMS), t, s=s)
    assert names == same
    for x, y in zip(_rows(got, "site", "split", "ts", *names), _rows(want, "site", "split", "ts", *names), strict=True):
        assert x[:3] == y[:3] and x[3:] == [v if v is None else pytest.approx(v, rel=1e-7, abs=1e-7) for v in y[3:]]


@pytest.mark.parametrize("name", ["wn01_rolling_mean", "wn02_rolling_std", "wn03_rolling_min_max", "wn04_rolling_skew", "wn05_rolling_kurt",
                                  "wn12_13_ewm", "tier1_matrix", "tier2_matrix"])
def test_whole_sites_need_no_windows(spark, name):
    plan = getattr(catalog, f"q_{name}")(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x]) == 1


def test_one_large_site_still_takes_blocks(spark, monkeypatch):
    cols = ["site", "param", "day"]
    for name in ("wn03_rolling_min_max", "wn12_13_ewm"):
        query = getattr(catalog, f"q_{name}")
        want = query(spark, SF_SMALL)
        cols = [*["site", "param", "day"], *[c for c in want.columns if c.startswith("v_")]]
        want = _rows(want, *cols)
        with monkeypatch.context() as m:
            m.setattr(EV, "TASK_ROWS", 10)
            cut = query(spark, SF_SMALL)
            assert "Window" in cut._jdf.queryExecution().executedPlan().toString()
            got = _rows(cut, *cols)
        for x, y in zip(got, want, strict=True):
            assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=2e-3)


def test_rounding_is_sparks(spark):
    xs = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 1.00005, 2.00015, -0.00004, 1e300, 123456.78905, float("nan"), float("inf"), None, 0.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits, scale in (({}, 10 ** 4), ({"x": "k10"}, 2 ** 10), ({"x": 0}, 1)):
        got = [r[0] for r in catalog.normalise(d, digits).collect()]
        assert repr(got) == repr([r[0] for r in d.selectExpr(f"round(x * {scale}D, 0) / {scale}D + 0D").collect()])


def test_candidates_of_batches_are_the_windows_rows(arrow):
    d = _days(arrow).where("site IS NOT NULL").withColumn("ts", F.date_add("ts", 150)).withColumnsRenamed({"a": PARAMS[0], "b": PARAMS[1]})
    cols = ["site", "param", "ts", "actual", "train_mean", *EV.BASE_MODELS]
    got, want = (_rows(EV.candidates_wide(interpolate(d, s, PARAMS[:2]), s, PARAMS[:2]), *cols) for s in (BATCHES, WHOLE))
    assert got and {r[0] for r in got} >= {"s0", "s2"}
    for x, y in zip(got, want, strict=True):
        assert x[:3] == y[:3] and x[3:] == [v if v is None else pytest.approx(v) for v in y[3:]]


def test_site_facts_are_the_series_own(spark):
    d = interpolate(_days(spark), BATCHES, ["a", "b"])
    facts = {r["site"]: r for r in EV.site_facts(d, ["a", "b"]).collect()}
    rows = [r for r in d.collect()]
    assert set(facts) == {r["site"] for r in rows}
    for site, f in facts.items():
        own = [r for r in rows if r["site"] == site]
        last = max(own, key=lambda r: r["ts"])
        for p in "ab":
            train = [r for r in own if r["ts"] < dt.date(2000, 1, 1) and r[p] is not None]
            assert f["ts"] == last["ts"] and f[f"last_{p}"] == last[p]
            assert f[f"train_mean_{p}"] == (pytest.approx(sum(r[p] for r in train) / len(train)) if train else None)
            for month, mean in f[f"clim_{p}"].items():
                x = [r[p] for r in train if r["ts"].month == month]
                assert mean == (pytest.approx(sum(x) / len(x)) if x else None)


def test_files_of_site_days_are_the_pivoted_ones(spark):
    from seriescast.sources.sinks import forecast_wide, predictions_wide, variance_detail_wide
    rows = [("s", dt.date(2000, 1, 1), 1.0, 2.0, 1.5, None), ("s", dt.date(2000, 1, 2), None, 2.0, 1.5, 0.0),
            ("s", dt.date(2000, 1, 3), 1.0, 2.0, None, None), ("t", dt.date(2000, 1, 1), 1.0, None, 1.0, 3.0)]
    wide = spark.createDataFrame(rows, "site string, ts date, a double, b double, predicted_a double, predicted_b double")
    long = EV.by_param(wide.withColumnsRenamed({"a": "T2M", "b": "PS", "predicted_a": "q_T2M", "predicted_b": "q_PS"}), ["T2M", "PS"],
                       {"actual": "{p}", "predicted": "q_{p}"}).replace({"T2M": "a", "PS": "b"}, subset=["param"])
    known = long.where("predicted IS NOT NULL")
    for make, source in ((predictions_wide, known), (variance_detail_wide, known), (forecast_wide, long)):
        got, want = make(wide, ["a", "b"]), make(source, ["a", "b"])
        assert got.columns == want.columns
        assert repr(_rows(got, "site", "DATE", *got.columns)) == repr(_rows(want, "site", "DATE", *got.columns))


def test_forecast_joins_no_series_and_writes_a_file_a_site(spark):
    import os

    plan = catalog.q_ml17_forecast_baseline(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InMemoryTableScan" not in plan
    files = [f for f in catalog.q_snk3_forecast_csv(spark, SF_SMALL).inputFiles()]
    assert len(files) == len({os.path.dirname(f) for f in files}) > 1


@pytest.mark.parametrize("name", ["src2_predictions_csv", "snk4_variance_csv"])
def test_files_of_candidates_need_no_pivot(spark, name, monkeypatch):
    wrote = []
    monkeypatch.setattr(catalog, "write_table", lambda df, path, *a, **k: wrote.append(df) or df.write.partitionBy("site").option("header", True).csv(path))
    getattr(catalog, f"q_{name}")(spark, SF_SMALL)
    plan = wrote[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x]) == 1


def test_forest_meets_its_days_without_a_join(spark):
    plan = catalog.q_ml06_random_cut_forest(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_rows_without_a_time_keep_the_ewm_of_blocks(spark, tmp_path):
    rows = [(k % 2, float(k % 7 + 1), 100.0 + k, 0.05, 0.03, None if k == 5 else dt.datetime(1999, 1, 1) + dt.timedelta(days=k)) for k in range(40)]
    names = "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = catalog.q_wn12_13_ewm(spark, str(tmp_path))
    assert "Window" in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 39 * len(PARAMS)
    assert not EV.days_series(spark, str(tmp_path), batches=True, untimed=False).batches
    assert EV.days_series(spark, str(tmp_path), batches=True).batches
