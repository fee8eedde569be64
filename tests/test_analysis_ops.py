"""Aggregates, quantiles, scaling, folds, blends and sources against numpy / hand results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriescast.operators import ensemble as E
from seriescast.operators import variance as V
from seriescast.operators.folds import contiguous_folds, time_series_folds
from seriescast.operators.metrics import regression_metrics
from seriescast.operators.quantile import exact_quantiles, exact_quantiles_wide
from seriescast.operators.ensemble import ridge_cv
from seriescast.operators.folds import time_segments
from seriescast.operators.scale import robust_fit, robust_fit_wide, standard_fit, standard_fit_wide, to_long


def test_exact_quantiles_small_and_refined(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 5000)
    b = np.concatenate([np.full(3000, 2.5), rng.exponential(1, 1001)])  # heavy ties
    pdf = pd.DataFrame({"g": ["a"] * len(a) + ["b"] * len(b), "x": np.concatenate([a, b])})
    df = spark.createDataFrame(pdf)
    for slack in (None, 1e-9, 1.0):   # sketch brackets, brackets that must be widened, the whole range
        q = exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.75, 0.9], k=16, slack=slack)
        got = q.toPandas().set_index("g").sort_index()
        for g, vals in (("a", a), ("b", b)):
            exp = np.quantile(vals, [0.25, 0.5, 0.75, 0.9])
            np.testing.assert_allclose(got.loc[g].to_numpy(dtype=float), exp, rtol=0, atol=1e-12)


def test_exact_quantiles_hot_group_and_null_key(spark):
    """A third of all rows in one group; nulls and non-finite values are left out."""
    df = (spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('g', id % 40) END AS g",
                                         "CASE id % 1000 WHEN 7 THEN NULL WHEN 8 THEN double('NaN') WHEN 9 THEN double('-inf') "
                                         "ELSE (id * 7919 % 60013) / 13.0 END AS x"))
    got = {r["g"]: (r["q0_1"], r["q0_5"]) for r in exact_quantiles(df, ["g"], "x", [0.1, 0.5]).collect()}
    pdf = df.toPandas()
    pdf = pdf[np.isfinite(pdf["x"].astype(float))]
    want = {None if g == "-" else g: tuple(np.quantile(v, [0.1, 0.5])) for g, v in
            pdf.assign(g=pdf["g"].fillna("-")).groupby("g")["x"]}
    assert set(got) == set(want)
    for g in want:
        np.testing.assert_allclose(got[g], want[g], rtol=0, atol=1e-9)


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(10, 3, 400)
    p = a + rng.normal(0, 1, 400)
    tm = 9.5
    df = spark.createDataFrame(pd.DataFrame({"param": "x", "model": "m", "actual": a, "predicted": p,
                                             "train_mean": tm}))
    m = regression_metrics(df, ["param", "model"]).first()
    e = a - p
    mse = np.mean(e ** 2)
    assert m["n"] == 400
    assert m["mse"] == pytest.approx(mse)
    assert m["rmse"] == pytest.approx(np.sqrt(mse))
    assert m["mae"] == pytest.approx(np.mean(np.abs(e)))
    assert m["r2"] == pytest.approx(1 - np.sum(e ** 2) / np.sum((a - a.mean()) ** 2))
    assert m["variance"] == pytest.approx(np.var(e))
    assert m["mape"] == pytest.approx(np.mean(np.abs(e / (np.abs(a) + 1e-10))) * 100)
    base = np.mean((a - tm) ** 2)
    assert m["improvement"] == pytest.approx((base - mse) / base * 100)
    r = e / (p + 1e-10)
    assert m["tight_pct"] == pytest.approx(np.mean((r >= -0.1) & (r <= 0.1)) * 100)
    # cross-check (d): variance + mean(e)^2 = MSE
    assert m["variance"] + m["mean_error"] ** 2 == pytest.approx(m["mse"])


def test_r2_zero_variance_rule(spark):
    df = spark.createDataFrame([("x", "m", 5.0, 5.0)] * 20 + [("y", "m", 5.0, 4.0)] * 20,
                               "param string, model string, actual double, predicted double")
    got = {r["param"]: r["r2"] for r in regression_metrics(df, ["param", "model"]).collect()}
    assert got == {"x": 1.0, "y": 0.0}


def test_range_edges_and_breakdown_totals(spark):
    # percent variances exactly -10, -5, 0, 5, 10 (predicted 100): closed and open ends
    acts = [90.0, 95.0, 100.0, 105.0, 110.0, 80.0, 130.0]
    df = spark.createDataFrame([("T2M", a, 100.0) for a in acts], "param string, actual double, predicted double")
    rc = {r["range"]: r["count"] for r in V.range_counts(df).collect()}
    assert rc == {"<-10%": 1, "<-5%": 1, "-5% to 0%": 1, "0% to +5%": 2, ">5% to 10%": 1, ">10%": 1}
    bd = V.range_breakdown(df, ["T2M", "PS"]).orderBy("range_order").collect()
    assert [r["TOTAL"] for r in bd] == [1, 1, 1, 2, 1, 1]
    assert sum(r["PS"] for r in bd) == 0


def test_variance_summary_and_best_worst_ties(spark):
    rows = []
    for p, preds in (("A", [100.0] * 4), ("B", [100.0] * 4), ("C", [50.0] * 4)):
        rows += [(p, 100.0, x) for x in preds]
    df = spark.createDataFrame(rows, "param string, actual double, predicted double")
    s = V.variance_summary(df)
    got = {r["param"]: r for r in s.collect()}
    assert got["A"]["Percentage_In_Range"] == 100.0 and got["C"]["Records_In_Range"] == 0
    assert got["C"]["Median_Variance"] == pytest.approx(1.0)
    bw = V.best_worst(s, ["A", "B", "C"]).first()
    assert bw["best_param"] == "A" and bw["worst_param"] == "C"


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 1000)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    got = V.histogram(df, ["k"], "x", 50).orderBy("bin").toPandas()
    cnt, edges = np.histogram(x, bins=50)
    assert got["count"].tolist() == cnt.tolist()
    np.testing.assert_allclose(got["bin_lo"], edges[:-1], atol=1e-12)
    const = spark.createDataFrame(pd.DataFrame({"k": "c", "x": np.full(7, 3.0)}))
    got_c = V.histogram(const, ["k"], "x", 50).orderBy("bin").toPandas()
    cnt_c, _ = np.histogram(np.full(7, 3.0), bins=50)
    assert got_c["count"].tolist() == cnt_c.tolist()


def test_scalers_match_sklearn_rules(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(5, 2, 301)
    pdf = pd.DataFrame({"feature": ["f"] * 301 + ["c"] * 301, "x": np.concatenate([x, np.full(301, 7.0)])})
    df = spark.createDataFrame(pdf)
    st = {r["feature"]: r for r in standard_fit(df).collect()}
    assert st["f"]["centre"] == pytest.approx(x.mean()) and st["f"]["scale"] == pytest.approx(x.std())
    assert st["c"]["scale"] == 1.0
    wide = {r["feature"]: r for r in standard_fit_wide(
        spark.createDataFrame(pd.DataFrame({"f": x, "c": 7.0})).repartition(3), ["f", "c"]).collect()}
    for f in "fc":
        assert wide[f]["centre"] == pytest.approx(st[f]["centre"]) and wide[f]["scale"] == pytest.approx(st[f]["scale"])
    rb = {r["feature"]: r for r in robust_fit(df).collect()}
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    assert rb["f"]["centre"] == pytest.approx(q2) and rb["f"]["scale"] == pytest.approx(q3 - q1)
    assert rb["c"]["scale"] == 1.0


@pytest.mark.parametrize("k, slack, sample", [(2048, None, 1 << 18), (64, None, 900), (64, 1e-4, 300)])
def test_wide_quantiles_match_numpy(spark, k, slack, sample):
    """Ties, constants, nulls, NaN, infinities, few values and none; also small samples and brackets too narrow at first."""
    rng = np.random.default_rng(8)
    cols = {"a": rng.normal(0, 1, 6000), "tied": rng.integers(0, 5, 6000) * 1.0, "same": np.full(6000, 7.0),
            "holes": np.where(rng.random(6000) < 0.3, np.nan, rng.exponential(3, 6000)), "one": np.full(6000, np.nan),
            "few": np.full(6000, np.nan), "none": np.full(6000, np.nan), "hot": np.where(rng.random(6000) < 0.34, 2.5, rng.normal(2, 1, 6000))}
    cols["one"][5], cols["few"][[3, 4000, 5999]], cols["a"][:2] = 3.0, [1.0, -2.0, 9.0], [np.inf, -np.inf]
    df = spark.createDataFrame(pd.DataFrame(cols)).withColumn("one", F.nanvl("one", F.lit(None))).repartition(5)
    names = list(cols)
    got = {r["feature"]: r for r in exact_quantiles_wide(df, names, [0.0, 0.25, 0.5, 0.99, 1.0], list("vwxyz"), k, slack, sample).collect()}
    assert sorted(got) == sorted(set(names) - {"none"})
    for c, x in zip(names, cols.values()):
        if c != "none":
            want = np.quantile(x[np.isfinite(x)], [0.0, 0.25, 0.5, 0.99, 1.0])
            assert [got[c][n] for n in "vwxyz"] == pytest.approx(list(want), abs=1e-12), c
    assert exact_quantiles_wide(df.limit(0), names, [0.5]).count() == 0


def test_robust_scaler_of_a_wide_frame(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(pd.DataFrame({f"f{i}": rng.normal(i, i, 800) for i in range(40)}).assign(site=1)).repartition(4)
    cols = [f"f{i}" for i in range(40)]
    wide = robust_fit_wide(df, cols)
    want = {r["feature"]: (r["centre"], r["scale"]) for r in robust_fit(to_long(df, ["site"], cols)).collect()}
    assert {r["feature"]: (r["centre"], r["scale"]) for r in wide.collect()} == want
    assert "Expand" not in wide._jdf.queryExecution().executedPlan().toString()


def test_folds_match_split_arithmetic(spark):
    days = pd.date_range("2020-01-01", periods=4017, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"site": "s", "ts": days.date}))
    tf = time_series_folds(df).toPandas()
    size = 4017 // 6
    assert size == 669
    for k in range(5):
        f = tf[tf.fold == k]
        test_start = 4017 - (5 - k) * size
        assert (f.role == "train").sum() == test_start
        assert (f.role == "test").sum() == size
    assert (tf[tf.fold == 0].role == "train").sum() == 672
    cf = contiguous_folds(df).toPandas().sort_values("ts")
    sizes = cf.groupby("fold").size().tolist()
    assert sizes == [804, 804, 803, 803, 803]
    assert cf["fold"].is_monotonic_increasing


def test_blends_weights_choice_and_ridge(spark):
    rng = np.random.default_rng(7)
    n = 300
    a = rng.normal(10, 2, n)
    m1 = a + rng.normal(0, 0.5, n)
    m2 = a + rng.normal(0, 1.5, n)
    rows = ([("p", i, "m1", float(a[i]), float(m1[i])) for i in range(n)]
            + [("p", i, "m2", float(a[i]), float(m2[i])) for i in range(n)])
    df = spark.createDataFrame(rows, "param string, t long, model string, actual double, predicted double")
    w = {r["model"]: r["weight"] for r in E.r2_weights(df, ["param"], ["m1", "m2"]).collect()}
    assert sum(w.values()) == pytest.approx(1.0) and w["m1"] > w["m2"]
    fb = E.fixed_blend(df, {"m1": 0.6, "m2": 0.4}).orderBy("t").toPandas()
    np.testing.assert_allclose(fb["predicted"], 0.6 * m1 + 0.4 * m2)
    # blend lies within its members for non-negative weights
    lo, hi = np.minimum(m1, m2), np.maximum(m1, m2)
    assert ((fb["predicted"] >= lo - 1e-12) & (fb["predicted"] <= hi + 1e-12)).all()
    met = regression_metrics(df, ["param", "model"])
    ch = E.choose(met, ["param"], ["m1", "m2"]).first()
    assert ch["chosen_model"] == "m1" and ch["chosen_score"] == max(r["r2"] for r in met.collect())
    tie = spark.createDataFrame([("p", "m2", 0.5), ("p", "m1", 0.5)], "param string, model string, r2 double")
    assert E.choose(tie, ["param"], ["m1", "m2"]).first()["chosen_model"] == "m1"
    wide = E.wide_candidates(df, ["param", "t"], ["m1", "m2"])
    coefs = E.ridge_fit(wide, ["param"], ["m1", "m2"], alpha=1.0).first()
    X = np.column_stack([m1, m2])
    Xc, yc = X - X.mean(0), a - a.mean()
    wv = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
    assert coefs["w_m1"] == pytest.approx(wv[0]) and coefs["w_m2"] == pytest.approx(wv[1])
    assert coefs["intercept"] == pytest.approx(a.mean() - X.mean(0) @ wv)


def test_daily_csv_reader(spark, tmp_path):
    from seriescast.sources.csv import read_daily_csv
    pre = "\n".join(["-BEGIN HEADER-"] + [f"line {i}" for i in range(16)] + ["-END HEADER-"])
    (tmp_path / "siteA.csv").write_text(pre + "\nYEAR,MO,DY,T2M,PS\n2024,2,29,-999,90.5\n2024,12,31,3.5,-999\n")
    (tmp_path / "siteB.csv").write_text("junk\nYEAR,MO,DY,PS,T2M\n2024,1,1,91.0,4.0\n")
    out = read_daily_csv(spark, str(tmp_path), params=["T2M", "PS"]).orderBy("site", "ts").collect()
    assert [(r.site, str(r.ts), r.T2M, r.PS) for r in out] == [
        ("siteA", "2024-02-29", None, 90.5), ("siteA", "2024-12-31", 3.5, None),
        ("siteB", "2024-01-01", 4.0, 91.0)]


def test_calendar_edge_dates(spark):
    from seriescast.functions.calendar import calendar_columns
    df = spark.createDataFrame([("2024-02-29",), ("2024-12-30",), ("2024-12-31",)], "d string").select(
        F.to_date("d").alias("ts"))
    cols = calendar_columns("ts", 3)
    got = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    ts = pd.to_datetime(["2024-02-29", "2024-12-30", "2024-12-31"])
    assert [r.day_of_year for r in got] == list(ts.dayofyear)
    assert [r.week_of_year for r in got] == [int(w) for w in ts.isocalendar().week]
    assert [r.is_weekend for r in got] == [int(d in (5, 6)) for d in ts.dayofweek]


def test_prediction_file_roundtrip(spark, tmp_path):
    """SNK2 wide layout written as CSV and read back by SRC2 / SRC4."""
    from seriescast.sources.csv import read_predictions_csv
    from seriescast.sources.sinks import predictions_wide, write_table
    rows = [("s", "2024-01-0%d" % d, p, float(d), float(d) + 0.5) for d in (1, 2) for p in ("T2M", "PS")]
    pred = spark.createDataFrame(rows, "site string, d string, param string, actual double, predicted double")
    pred = pred.withColumn("ts", F.to_date("d")).drop("d")
    wide = predictions_wide(pred, ["T2M", "PS"])
    assert wide.columns[:5] == ["site", "YEAR", "MO", "DY", "DATE"] and len(wide.columns) == 5 + 12
    out = str(tmp_path / "pred")
    write_table(wide.drop("site"), out, fmt="csv")
    back = read_predictions_csv(spark, out, ["T2M", "PS"]).orderBy("param", "ts").collect()
    assert [(r.param, str(r.ts), r.actual, r.predicted) for r in back] == [
        ("PS", "2024-01-01", 1.0, 1.5), ("PS", "2024-01-02", 2.0, 2.5),
        ("T2M", "2024-01-01", 1.0, 1.5), ("T2M", "2024-01-02", 2.0, 2.5)]


def test_daily_csv_files_with_one_base_name(spark, tmp_path):
    from seriescast.sources.csv import read_daily_csv
    for folder, text in (("x", "YEAR,MO,DY,T2M,PS\n2024,1,1,5.0,92.0\n"), ("y", "YEAR,MO,DY,PS,T2M\n 2024,1,2,92.5,5.5\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "daily.csv").write_text(text)
    out = read_daily_csv(spark, [str(tmp_path / "x"), str(tmp_path / "y")], params=["T2M", "PS"]).orderBy("ts").collect()
    assert [(r.site, r.T2M, r.PS) for r in out] == [("daily", 5.0, 92.0), ("daily", 5.5, 92.5)]


def test_daily_csv_cells_are_read_by_place(spark, tmp_path):
    from seriescast.sources.csv import parse_lines, read_lines
    (tmp_path / "odd.csv").write_text("YEAR,MO,DY,PS,X\n2024, 2 ,29, 90.5 ,-999\n2024,3,1,7,1\n")
    df = parse_lines(read_lines(spark, str(tmp_path)), ["T2M", "PS", "X"])
    assert [tuple(r) for r in df.select("MO", "T2M", "PS", "X").orderBy("MO").collect()] == [(2, None, 90.5, None), (3, None, 7.0, 1.0)]
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "odd.csv").write_text("YEAR,MO,DY,PS\n2024,2,29\n")
    with pytest.raises(Exception, match="fewer cells"):
        read_lines(spark, str(tmp_path)).transform(parse_lines, ["PS"]).collect()


def test_daily_csv_without_header_fails(spark, tmp_path):
    from seriescast.sources.csv import read_daily_csv
    (tmp_path / "bare.csv").write_text("2024,1,1,5.0,92.0\n")
    with pytest.raises(Exception, match="no header row"):
        read_daily_csv(spark, str(tmp_path), params=["T2M", "PS"]).collect()


def test_prediction_file_keeps_sites(spark, tmp_path):
    from seriescast.sources.csv import read_predictions_csv
    from seriescast.sources.sinks import predictions_wide, write_table
    rows = [(s, "2024-01-01", p, v, v + 1) for s, v in (("a", 1.0), ("b", 2.0)) for p in ("T2M", "PS")]
    pred = spark.createDataFrame(rows, "site string, d string, param string, actual double, predicted double")
    out = str(tmp_path / "pred")
    write_table(predictions_wide(pred.withColumn("ts", F.to_date("d")).drop("d"), ["T2M", "PS"]), out, fmt="csv")
    back = read_predictions_csv(spark, out, ["T2M", "PS"])
    assert sorted((r.site, r.param, r.actual) for r in back.collect()) == sorted((r[0], r[2], r[3]) for r in rows)


def test_improvement_uses_one_row_set(spark):
    from seriescast.operators.metrics import regression_metrics
    df = spark.createDataFrame([("p", 1.0, 1.5, 2.0), ("p", 3.0, 2.5, None), ("q", 1.0, 2.0, 3.0)],
                               "param string, actual double, predicted double, train_mean double")
    got = {r["param"]: r["improvement"] for r in regression_metrics(df, ["param"]).collect()}
    assert got["p"] is None and abs(got["q"] - 75.0) < 1e-9


def test_ridge_cv_matches_refitting(spark):
    """Fold scores from segment moments equal a ridge refitted on each fold's rows, far from zero."""
    rng = np.random.default_rng(5)
    n = 130
    x = rng.normal(1e4, 1, (n, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, .1, n)
    days = pd.date_range("2024-01-01", periods=n).date
    pdf = pd.DataFrame({"param": "p", "ts": days, "a": x[:, 0], "b": x[:, 1], "actual": y})
    df = spark.createDataFrame(pd.concat([pdf, pdf.assign(param="q", actual=7.0)]))
    got = {(r["param"], r["fold"]): (r["n_train"], r["r2"])
           for r in ridge_cv(time_segments(df), ["param"], ["a", "b"]).collect()}
    size = n // 6
    for fold in range(5):
        cut = n - (5 - fold) * size
        xt, yt = x[:cut], y[:cut]
        w = np.linalg.solve((xt - xt.mean(0)).T @ (xt - xt.mean(0)) + np.eye(2), (xt - xt.mean(0)).T @ (yt - yt.mean()))
        test, res = y[cut:cut + size], y[cut:cut + size] - (yt.mean() + (x[cut:cut + size] - xt.mean(0)) @ w)
        n_train, r2 = got[("p", fold)]
        assert n_train == cut
        np.testing.assert_allclose(r2, 1 - (res ** 2).sum() / ((test - test.mean()) ** 2).sum(), rtol=1e-6)
        assert got[("q", fold)][1] == 1.0
