"""Registered queries: one per inventory row that yields a table.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables,
built only from the library's operators.  ``normalise`` gives every result the
same surface as its DuckDB oracle: dates as ISO strings, integers as bigint,
doubles rounded (4 digits unless stated; 3 for skew, kurtosis and EWM, whose
summation orders differ most between engines) with ``-0.0`` folded to ``0.0``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from seriescast.config import PARAMS, RANGE_LABELS
from seriescast.functions import calendar as C
from seriescast.functions.errors import (accuracy_band, bias_band, error, percent_error, r2_band,
                                         spread_band, variance_ratio)
from seriescast.functions.physics import interaction_columns, physics_columns
from seriescast.operators import ensemble as E
from seriescast.operators import histtrees as H
from seriescast.operators import rolling as R
from seriescast.operators import variance as V
from seriescast.operators.ewm import EWM_BLOCK, ewm, ewm_stage
from seriescast.operators.fill import interpolate, nonfinite_to_null, sentinel_to_null, sweep
from seriescast.operators.folds import contiguous_folds, time_segments, time_series_folds
from seriescast.operators.metrics import cv_summary, macro_summary, r2_score, regression_metrics
from seriescast.operators.scale import apply_long, robust_fit, standard_fit
from seriescast.operators.seasonal import seasonal_means
from seriescast.operators.series import WHOLE_TASKS, Series, reused, small_side
from seriescast.operators.spells import spells
from seriescast.plans import evaluate as EV
from seriescast.plans.features import KEYS, build_matrix, clean_matrix, only_trailing, tier_halo
from seriescast.plans.tiers import TIERS, Tier
from seriescast.sources.calendar import calendar_fill, forecast_calendar
from seriescast.session import ensure_checkpoint_dir
from seriescast.sources.csv import read_daily_csv, read_predictions_csv
from seriescast.sources.fixtures import (DAY0, hourly_events, observations_long, observations_wide,
                                         priority_daily)
from seriescast.sources.sinks import (forecast_wide, metrics_table, predictions_wide, variance_detail_wide,
                                      write_daily_csv, write_table)

S = Series()
WINDOWS = [3, 7, 14, 30, 60, 90]
LAGS = [1, 2, 3, 7, 14, 30, 60, 90, 365]
DIFFS = [1, 7, 14, 30]
SPANS = [7, 14, 30, 60]


def _half_up(y: str) -> str:
    """SQL of ``round(y, 0)`` of a double (but for the sign of 0), without the decimals that Spark makes of every value.
    ``y - rint(y)`` is exact, so ties are found and go away from 0."""
    return f"(CASE WHEN abs({y} - rint({y})) = 0.5D THEN {y} + signum({y}) * 0.5D ELSE rint({y}) END)"


def normalise(df: DataFrame, digits: dict[str, int] | None = None, default: int = 4) -> DataFrame:
    digits = digits or {}
    cols = []
    for f in df.schema.fields:
        c, t = f"`{f.name}`", f.dataType
        if isinstance(t, T.DateType):
            c = f"date_format({c}, 'yyyy-MM-dd')"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            c = f"CAST({c} AS BIGINT)"
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            nd = digits.get(f.name, default)
            x = f"CAST({c} AS DOUBLE)"
            if isinstance(nd, str) and nd.startswith("g"):  # significant digits, for values spanning many magnitudes
                k = f"({int(nd[1:]) - 1} - CAST(floor(log10(abs({x}))) AS INT))"
                up, down = _half_up(f"{x} * pow(10D, {k})"), _half_up(f"{x} / pow(10D, -{k})")
                c = (f"CASE WHEN {x} IS NULL OR {x} = 0D THEN {x} "
                     f"WHEN {k} >= 0 THEN {up} / pow(10D, {k}) ELSE {down} * pow(10D, -{k}) END + 0D")
            else:
                # round(x * s) / s on the binary value, as DuckDB does (``_half_up``); "k": binary grid 2^-n, as
                # scale-free statistics of discrete data are rationals that can sit exactly on a
                # decimal rounding tie
                scale = 2 ** int(nd[1:]) if isinstance(nd, str) else 10 ** nd
                c = f"{_half_up(f'{x} * {scale}D')} / {scale}D + 0D"
        cols.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*cols)


# columns whose values span many magnitudes (guards of 1e-10 in a denominator):
# compared on 6 significant digits instead of fixed decimals
SIG6 = {"mape": "g6", "avg_mape": "g6", "percent_error": "g6", "ratio": "g6",
        "Mean_Variance": "g6", "Median_Variance": "g6", "Std_Variance": "g6",
        "Min_Variance": "g6", "Max_Variance": "g6"}


def _day(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("ts", "day")


def _clean(spark, sf, param: str | None = None) -> DataFrame:
    """The cleaned series; with ``param`` only that parameter is read into the clean."""
    return EV.cleaned(spark, sf, "supp", S, param)


def _blocked(spark, sf, halo: int, params: list[str] | None = None, block_rows: int = S.block_rows) -> tuple[DataFrame, Series]:
    """The cleaned series in blocks with a halo, dealt out as site days, and how they lie."""
    days = EV.days_series(spark, sf, S.with_blocks(block_rows), whole=block_rows == S.block_rows)
    wide = EV.blocked_days(EV.cleaned_days(spark, sf, days, params), days, halo)
    return EV.by_param(wide, params), days.with_keys(*S.keys)


def _features(spark, sf, exprs: dict, halo: int, stages: list | None = None) -> DataFrame:
    stages = [exprs] + (stages or [])
    names = [n for st in stages for n in st]
    days = EV.days_series(spark, sf, S, batches=R.batchable(stages))
    wide = EV.cleaned_days(spark, sf, days)
    if days.batches:
        out = R.trailing_days(wide, days, stages, PARAMS, long=True)
    else:
        d = EV.by_param(EV.blocked_days(wide, days, halo))
        out = R.trailing(d, days.with_keys(*S.keys), stages, halo=halo)
    return out.select("site", "param", F.col("ts").alias("day"), *names)


# ---------------------------------------------------------------- sources, cleaning
def q_src_observations_long(spark, sf):
    d = observations_long(spark, sf, "supp").withColumn("value", sentinel_to_null("value"))
    return normalise(_day(d.select("site", "param", "ts", "value")))


def q_src5_forecast_calendar(spark, sf):
    cal = forecast_calendar(observations_wide(spark, sf, "supp"), ["site"])
    return normalise(_day(cal.select("site", "ts", "YEAR", "MO", "DY")))


def q_src5_calendar_gap_fill(spark, sf):
    pr = priority_daily(spark, sf).withColumn("param", F.lit("total_price"))
    full = calendar_fill(pr, ["site", "param"]).withColumn("raw", F.col("value"))
    out = interpolate(full, S)
    return normalise(_day(out.select("site", "ts", "raw", "value")))


def q_wn14_interpolate(spark, sf):
    return normalise(_day(_clean(spark, sf).select("site", "param", "ts", "value")))


def _scratch(spark, name: str) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_src1_daily_csv(spark, sf):
    """SRC1, SRC3, PRJ4, PRJ5: raw files per site (preamble, header, sentinels, some cells not finite)
    written to the checkpoint folder and read back through the scan, all files in one pass."""
    path = _scratch(spark, "daily-csv")
    dn = F.datediff("ts", F.lit(DAY0).cast("date"))
    odd = {p: F.when(F.pmod(dn + i, F.lit(17)) == 0, F.lit(float("nan")))
               .when(F.pmod(dn + i, F.lit(19)) == 0, F.lit(float("inf")))
               .when(F.pmod(dn + i, F.lit(23)) == 0, F.lit(float("-inf"))).otherwise(F.col(p)) for i, p in enumerate(PARAMS)}
    write_daily_csv(observations_wide(spark, sf, "supp").withColumns(odd), path)
    got = read_daily_csv(spark, path).withColumns({p: nonfinite_to_null(p) for p in PARAMS})
    return normalise(got.select("site", F.col("ts").alias("day"), "YEAR", "MO", "DY", *PARAMS))


def q_src2_predictions_csv(spark, sf):
    """SRC2, SRC4, SNK2: the wide prediction file written per site and read back long."""
    path = _scratch(spark, "predictions-csv")
    write_table(predictions_wide(_model_days(spark, sf, "persistence")), path, "csv", by_site=True)
    got = read_predictions_csv(spark, path, model="persistence").where("actual IS NOT NULL")
    got = got.withColumns({"error": error(), "percent_error": percent_error()})
    return normalise(_day(got.select("site", "param", "ts", "model", "actual", "predicted", "error", "percent_error")),
                     {"percent_error": "g6"})


def _read_back(spark, df: DataFrame, name: str, by_site: bool = False) -> DataFrame:
    path = _scratch(spark, name)
    write_table(df, path, "csv", by_site=by_site)
    return spark.read.option("header", True).schema(df.schema).csv(path).select(*df.columns)


def q_snk1_metrics_csv(spark, sf):
    """SNK1: the metrics file of the chosen models, written and read back."""
    allm = _all_models(spark, sf)
    met = regression_metrics(allm, ["param", "model"])
    pick = E.choose(met, ["param"], EV.CHOICE_ORDER).select("param", F.col("chosen_model").alias("model"))
    got = _read_back(spark, metrics_table(met.join(pick, ["param", "model"])), "metrics-csv")
    return normalise(got.withColumnsRenamed({c: c.lower() for c in got.columns}), SIG6)


def q_snk3_forecast_csv(spark, sf):
    """SNK3: the wide forecast file written per site and read back."""
    wide = forecast_wide(_forecast_days(spark, sf)[0])
    return normalise(_read_back(spark, wide, "forecast-csv", by_site=True).withColumnRenamed("DATE", "day"))


def q_snk4_variance_csv(spark, sf):
    """SNK4: the variance detail written per site and read back."""
    wide = variance_detail_wide(_model_days(spark, sf, "climatology"))
    got = _read_back(spark, wide, "variance-csv", by_site=True)
    return normalise(got.withColumnRenamed("DATE", "day"), {f"{p}_VARIANCE": "g6" for p in PARAMS})


def q_snk5_breakdown_csv(spark, sf):
    """SNK5: the breakdown matrix written and read back."""
    return normalise(_read_back(spark, V.range_breakdown(_chosen(spark, sf)), "breakdown-csv"))


# ---------------------------------------------------------------- trailing windows
def q_wn01_rolling_mean(spark, sf):
    return normalise(_features(spark, sf, R.rolling_stats("value", WINDOWS, ("mean",), "v"), 90))


def q_wn02_rolling_std(spark, sf):
    return normalise(_features(spark, sf, R.rolling_stats("value", WINDOWS, ("std",), "v"), 90))


def q_wn03_rolling_min_max(spark, sf):
    return normalise(_features(spark, sf, R.rolling_stats("value", WINDOWS, ("min", "max"), "v"), 90))


def _moments(spark, sf, which: str) -> DataFrame:
    stages = R.moment_stages("value", WINDOWS, (which,), "v")
    return _features(spark, sf, stages[0], 90, stages[1:])


def q_wn04_rolling_skew(spark, sf):
    return normalise(_moments(spark, sf, "skew"), default="k10")


def q_wn05_rolling_kurt(spark, sf):
    return normalise(_moments(spark, sf, "kurt"), default="k10")


def q_wn06_rain_rolling_sum(spark, sf):
    d, s = _blocked(spark, sf, 30, ["PRECTOTCORR"])
    out = R.trailing(d, s, [{"precip_cumsum_7": R.vsum("value", 7),
                             "precip_cumsum_30": R.vsum("value", 30)}], halo=30)
    return normalise(_day(out.select("site", "ts", "precip_cumsum_7", "precip_cumsum_30")))


def q_wn07_lags(spark, sf):
    return normalise(_features(spark, sf, {f"v_lag_{k}": R.lag_bfill("value", k) for k in LAGS}, 365))


def q_wn08_diffs(spark, sf):
    return normalise(_features(spark, sf, {f"v_diff_{k}": R.diff("value", k) for k in DIFFS}, 30))


def q_wn09_pressure_tendency(spark, sf):
    d, s = _blocked(spark, sf, 7, ["PS"])
    out = R.trailing(d, s, [{"pressure_tendency_3day": R.diff("value", 3, fill0=False),
                             "pressure_tendency_7day": R.diff("value", 7, fill0=False)}], halo=7)
    out = sweep(out, s, ["pressure_tendency_3day", "pressure_tendency_7day"])
    return normalise(_day(out.select("site", "ts", "pressure_tendency_3day", "pressure_tendency_7day")))


def q_wn10_pct_change(spark, sf):
    d, s = _blocked(spark, sf, 30)
    names = [f"v_diff_pct_{k}" for k in DIFFS]
    out = R.trailing(d, s, [{n: R.pct_change("value", k) for n, k in zip(names, DIFFS)}], halo=30)
    out = sweep(out, s, names)
    return normalise(_day(out.select("site", "param", "ts", *names)))


def q_wn11_diff_rolling(spark, sf):
    st2 = {"v_diff_rolling_7": R.mean("v_diff_1", 7), "v_diff_rolling_30": R.mean("v_diff_1", 30)}
    out = _features(spark, sf, {"v_diff_1": R.diff("value", 1)}, 31, [st2])
    return normalise(out.select("site", "param", "day", *st2))


def q_wn12_13_ewm(spark, sf):
    days = EV.days_series(spark, sf, S, batches=True, untimed=False)    # ``ewm`` weighs series with such rows by their numbers
    if days.batches:
        out = R.trailing_days(EV.cleaned_days(spark, sf, days), days, [ewm_stage(SPANS, prefix="v")], PARAMS, long=True)
    else:
        d, s = _blocked(spark, sf, 0, block_rows=EWM_BLOCK)
        out = ewm(d, s, SPANS, prefix="v")
    names = [f"v_ewm_{k}" for k in SPANS] + [f"v_ewm_std_{k}" for k in SPANS]
    return normalise(_day(out.select("site", "param", "ts", *names)), default=3)


def q_wn17_18_spells(spark, sf):
    d, s = _blocked(spark, sf, 0, ["PRECTOTCORR"])
    out = spells(d, s)
    return normalise(_day(out.select("site", "ts", "dry_spell_length", "wet_spell_length")))


def q_ag24_wn19_seasonal(spark, sf):
    days = EV.days_series(spark, sf, S)
    wide = seasonal_means(EV.cleaned_days(spark, sf, days), days, cols=PARAMS)
    cols = ["v_yearly_avg", "v_monthly_avg", "v_deviation_from_yearly", "v_deviation_from_monthly"]
    out = EV.by_param(wide, columns={c: "{p}" + c[1:] for c in cols})
    return normalise(_day(out.select("site", "param", "ts", *cols)))


def q_wn01_hourly_rolling(spark, sf):
    s = Series(order="ts", bucket="to_date(ts)")
    d = hourly_events(spark, sf)
    out = R.trailing(d, s, [{"rolling_3": R.mean("value", 3), "rolling_24": R.mean("value", 24),
                             "rolling_std_24": R.std("value", 24)}], halo=24)
    return normalise(out.select("site", "ts", "value", "rolling_3", "rolling_24", "rolling_std_24"))


# ---------------------------------------------------------------- calendar, physics
def q_cal_features(spark, sf):
    wide = observations_wide(spark, sf, "supp").select("site", "ts")
    first = wide.groupBy("site").agg(F.min_by(F.year("ts"), "ts").alias("_fy"))
    d = wide.join(first, "site")
    cols = C.calendar_columns("ts", tier=3)
    cols.update({
        "day_length_hours": C.day_length_hours("ts"),
        "solar_noon_altitude": C.solar_noon_altitude("ts"),
        "days_since_year_start": C.days_since_first_year("ts", F.col("_fy")),
        "days_until_year_end": C.days_until_first_year_end("ts", F.col("_fy")),
    })
    return normalise(d.select("site", F.col("ts").alias("date"), *[c.alias(k) for k, c in cols.items()]))


def _clean_wide(spark, sf) -> DataFrame:
    return EV.cleaned_days(spark, sf, EV.days_series(spark, sf, S))


def q_ph_features(spark, sf):
    wide = _clean_wide(spark, sf)
    cols = physics_columns()
    cols.update(interaction_columns())
    return normalise(_day(wide.select("site", "ts", *[c.alias(k) for k, c in cols.items()])))


def _matrix(spark, sf, t: Tier) -> DataFrame:
    """The tier's whole feature matrix as the learners get it (before nulls become 0)."""
    # a task holds a site's rows with all columns: fewer rows where they are many
    days = EV.days_series(spark, sf, S.with_keys("site", "split"), batches=True, share=0.5 if t.physics else WHOLE_TASKS)
    if days.batches:
        out, feats = build_matrix(EV.cleaned_days(spark, sf, days, timed=not only_trailing(t)), t, s=days)
    elif only_trailing(t):
        wide = EV.blocked_days(EV.cleaned_days(spark, sf, days), days, tier_halo(t))
        out, feats = build_matrix(EV.by_param(wide), t, s=days.with_keys(*KEYS))
    else:
        out, feats = clean_matrix(observations_long(spark, sf, "supp"), t)
    digits = {f: "k10" for f in feats if "_skew_" in f or "_kurt_" in f}
    digits.update({f: 3 for f in feats if "_ewm_" in f})
    return normalise(out.withColumnRenamed("ts", "tday"), digits)


def q_tier1_matrix(spark, sf):
    return _matrix(spark, sf, TIERS[1])


def q_tier2_matrix(spark, sf):
    return _matrix(spark, sf, TIERS[2])


def q_tier3_matrix(spark, sf):
    return _matrix(spark, sf, TIERS[3])


# ---------------------------------------------------------------- predictions, metrics
IDS = ["site", "param", "ts"]


def _cands_wide(spark, sf) -> DataFrame:
    """Candidates, one column per model, read by several branches: persisted once, as site days."""
    days = EV.days_series(spark, sf, S, batches=True)
    test = EV.candidates_days(EV.cleaned_days(spark, sf, days), days)
    return EV.candidates_by_param(test.persist(StorageLevel.MEMORY_AND_DISK), days)


def _cands_once(spark, sf) -> DataFrame:
    """Candidates, one column per model, for branches of a single plan."""
    days = EV.days_series(spark, sf, S, batches=True)
    return EV.candidates_wide(EV.cleaned_days(spark, sf, days), days)


def _model_days(spark, sf, model: str) -> DataFrame:
    """Test days with the values and ``model``'s predictions of every parameter."""
    days = EV.days_series(spark, sf, S, batches=True)
    return EV.model_days(EV.candidates_days(EV.cleaned_days(spark, sf, days), days), days, model)


def _cands(spark, sf, cw: DataFrame | None = None) -> DataFrame:
    cw = cw if cw is not None else _cands_once(spark, sf)
    return EV.to_long(cw, EV.BASE_MODELS, IDS)


def q_er_prediction_errors(spark, sf):
    d = _cands(spark, sf)
    d = d.withColumns({"error": error(), "abs_error": F.abs(error()),
                       "percent_error": percent_error(), "variance": variance_ratio()})
    return normalise(_day(d.select("site", "param", "ts", "model", "actual", "predicted", "error",
                                   "abs_error", "percent_error", "variance")),
                     {"percent_error": "g6", "variance": "g6"})


def q_ag01_07_metrics(spark, sf):
    return normalise(regression_metrics(_cands(spark, sf), ["param", "model"]), SIG6)


def q_ml07_fixed_blend(spark, sf):
    b = E.fixed_blend(_cands_once(spark, sf), EV.FIXED_BLEND)
    return normalise(regression_metrics(b, ["param", "model"]), SIG6)


def q_ml08_r2_weights(spark, sf):
    return normalise(E.r2_weights(_cands(spark, sf), ["param"], EV.BASE_MODELS))


def _all_models(spark, sf, cw: DataFrame | None = None) -> DataFrame:
    """Candidates plus the R^2-weighted blend, long."""
    return EV.to_long(_all_wide(spark, sf, cw), EV.BASE_MODELS + ["weighted"], IDS)


def _all_wide(spark, sf, cw: DataFrame | None = None, w: DataFrame | None = None) -> DataFrame:
    """Candidates and the R^2-weighted blend, one column per model.  The blend is a projection of the
    wide candidates joined to the per-parameter weight row (one row for each of ``PARAMS``),
    so no row-level shuffle is needed.  The weights stay in the plan: where the candidates are not
    persisted, both branches read one shuffle of the site days; ``w`` holds them where they are known already."""
    cw = cw if cw is not None else _cands_once(spark, sf)
    w = w if w is not None else E.r2_weights(_cands(spark, sf, cw), ["param"], EV.BASE_MODELS)
    ww, blend = EV.weighted_column(w, EV.BASE_MODELS, ["param"])
    return cw.join(F.broadcast(ww), "param").withColumn("weighted", blend)


def _chosen(spark, sf) -> DataFrame:
    """Rows of each parameter's chosen model: one column of the wide candidates, nothing exploded for the others."""
    wide, models = _all_wide(spark, sf, _cands_wide(spark, sf)), EV.BASE_MODELS + ["weighted"]
    met = regression_metrics(EV.to_long(wide, models, IDS), ["param", "model"])
    pick = E.choose(met, ["param"], EV.CHOICE_ORDER)
    pick = small_side(pick.select("param", F.col("chosen_model").alias("model")))
    predicted = F.coalesce(*[F.when(F.col("model") == m, F.col(m)) for m in models])
    return (wide.join(pick, "param").select(*IDS, "model", "actual", predicted.alias("predicted"), "train_mean")
            .where(F.col("predicted").isNotNull()))


def q_ml10_model_choice(spark, sf):
    allm = _all_models(spark, sf)
    met = regression_metrics(allm, ["param", "model"])
    pick = E.choose(met, ["param"], EV.CHOICE_ORDER)
    out = pick.join(met.withColumnRenamed("model", "chosen_model"), ["param", "chosen_model"])
    return normalise(out.select("param", "chosen_model", "chosen_score", "n", "mse", "rmse", "mae",
                                "r2", "variance", "mape", "improvement", "tight_pct"), SIG6)


def q_ag08_09_variance_summary(spark, sf):
    return normalise(V.variance_summary(_chosen(spark, sf)), SIG6)


def q_ag10_overall_in_range(spark, sf):
    return normalise(V.overall_in_range(V.variance_summary(_chosen(spark, sf))))


def q_ag14_15_range_breakdown(spark, sf):
    return normalise(V.range_breakdown(_chosen(spark, sf)))


def q_ag16_17_range_shares(spark, sf):
    return normalise(V.range_shares(_chosen(spark, sf)))


def q_ag18_19_param_range_share(spark, sf):
    return normalise(V.range_share_by_param(_chosen(spark, sf)))


def q_ag20_error_histogram(spark, sf):
    d = _chosen(spark, sf).withColumn("error", error())
    return normalise(V.histogram(d, ["param"], "error", 50))


def q_ag15_19_breakdown_by_param(spark, sf):
    """AG19 with AG15's per-parameter totals; ``range_0`` .. ``range_5`` in the order of the labels."""
    out = V.range_breakdown_by_param(_chosen(spark, sf))
    return normalise(out.withColumnsRenamed({lab: f"range_{i}" for i, lab in enumerate(RANGE_LABELS)}))


def q_ag20_ratio_histogram(spark, sf):
    d = V.with_ratio(_chosen(spark, sf))
    return normalise(V.histogram(d, ["param"], "ratio", 50), {"bin_lo": "g6", "bin_hi": "g6"})


def q_ag23_cv_summary(spark, sf):
    """AG23 over the time folds (ML14): R^2 of yesterday's value on each fold's test days."""
    d, s = _blocked(spark, sf, 1)
    d = R.trailing(d, s, [{"predicted": R.lag_bfill("value", 1)}], halo=1)
    d = time_series_folds(d.select("param", "ts", F.col("value").alias("actual"), "predicted"))
    scores = r2_score(d.where((F.col("role") == "test") & F.col("predicted").isNotNull()), ["param", "fold"])
    return normalise(cv_summary(scores, ["param"]))


def q_ag11_13_quality_summary(spark, sf):
    met = regression_metrics(_chosen(spark, sf), ["param"])
    return normalise(macro_summary(met), SIG6)


def q_tk1_best_worst(spark, sf):
    return normalise(V.best_worst(V.variance_summary(_chosen(spark, sf))))


def q_gr_grade_bands(spark, sf):
    ch = _chosen(spark, sf)
    met = regression_metrics(ch, ["param"])
    vs = V.variance_summary(ch)
    d = met.join(vs, "param")
    return normalise(d.select("param", r2_band("r2", 2).alias("r2_band_t2"),
                              r2_band("r2", 3).alias("r2_band_t3"),
                              accuracy_band("tight_pct", (70.0, 60.0)).alias("tight_band_t2"),
                              accuracy_band("tight_pct", (90.0, 80.0, 70.0)).alias("tight_band_t3"),
                              accuracy_band("Percentage_In_Range", (90.0, 70.0)).alias("in_range_band"),
                              bias_band("Mean_Variance").alias("bias_band"),
                              spread_band("Std_Variance").alias("spread_band")))


# ---------------------------------------------------------------- folds, scaling, forecast
def q_ml14_time_folds(spark, sf):
    wide = observations_wide(spark, sf, "supp").select("site", "ts")
    return normalise(_day(time_series_folds(wide).select("site", "ts", "fold", "role")))


def q_ml12_contiguous_folds(spark, sf):
    wide = observations_wide(spark, sf, "supp").select("site", "ts")
    return normalise(_day(contiguous_folds(wide).select("site", "ts", "fold")))


def _scaled(spark, sf, fit, held: bool = False) -> DataFrame:
    """The cleaned series under a scaler.  With ``held`` the site days are persisted, once, for a fit of several passes."""
    wide = _clean_wide(spark, sf).select("site", "ts", *PARAMS)
    d = EV.by_param(reused(wide) if held else wide).select("site", "param", "ts", F.col("value").alias("x"),
                                                           EV.split_col("ts").alias("split"))
    fitted = fit(d.where(F.col("split") == "train").withColumnRenamed("param", "feature"))
    out = apply_long(d.withColumnRenamed("param", "feature"), fitted)
    return normalise(_day(out.select(F.col("feature").alias("param"), "site", "ts", F.col("x").alias("scaled"))))


def q_ml01_standard_scale(spark, sf):
    return _scaled(spark, sf, standard_fit)


def q_ml02_robust_scale(spark, sf):
    return _scaled(spark, sf, lambda rows: robust_fit(rows, held=True), held=True)


def _forecast_days(spark, sf) -> tuple[DataFrame, dict[str, str]]:
    """Next-year forecast with each parameter's chosen candidate (ML17, ML21 last value), a row per site and day:
    ``site, ts, predicted_<p>``; and the chosen models.

    Weights and choice (a row per parameter) are collected; what the forecast reads of a site is one row
    (``EV.site_facts``) that its calendar carries, so no series is joined to anything."""
    days = EV.days_series(spark, sf, S, batches=True)
    cleaned = EV.cleaned_days(spark, sf, days)
    cw = EV.candidates_wide(cleaned, days)
    w = reused(E.r2_weights(_cands(spark, sf, cw), ["param"], EV.BASE_MODELS))
    models = EV.BASE_MODELS + ["weighted"]
    met = regression_metrics(EV.to_long(_all_wide(spark, sf, cw, w), models, IDS), ["param", "model"])
    pick = E.choose(met, ["param"], EV.CHOICE_ORDER).select("param", "chosen_model")
    weight = {(r["param"], r["model"]): r["weight"] for r in w.select("param", "model", "weight").collect()}
    chosen = {r["param"]: r["chosen_model"] for r in pick.collect()}
    w.unpersist()
    facts = EV.site_facts(cleaned)
    cal = forecast_calendar(facts, ["site"], carry=[c for c in facts.columns if c not in ("site", "ts")])
    predicted = {}
    for p in PARAMS:
        of = {m: F.col(f"last_{p}") for m in EV.BASE_MODELS}
        of["climatology"] = F.coalesce(F.element_at(f"clim_{p}", F.col("MO")), F.col(f"train_mean_{p}"))
        blend = [F.lit(weight.get((p, m))).cast("double") * of[m] for m in EV.BASE_MODELS]
        of["weighted"] = sum(blend[1:], blend[0])
        predicted[p] = of.get(chosen.get(p), F.lit(None).cast("double"))
    cal = cal if chosen else cal.where(F.lit(False))
    return cal.select("site", "ts", *[predicted[p].alias(f"predicted_{p}") for p in PARAMS]), chosen


def _forecast_baseline(spark, sf) -> DataFrame:
    """``_forecast_days`` with a row per parameter and its chosen model; parameters without a choice are left out."""
    wide, chosen = _forecast_days(spark, sf)
    d = EV.by_param(wide, [p for p in PARAMS if p in chosen] or PARAMS, {"predicted": "predicted_{p}"})
    of = F.create_map(*[F.lit(x) for pair in (chosen or {"": ""}).items() for x in pair])
    return d.select("site", "param", "ts", of[F.col("param")].alias("chosen_model"), "predicted")


def q_ml17_forecast_baseline(spark, sf):
    return normalise(_day(_forecast_baseline(spark, sf)))


# ---------------------------------------------------------------- learners (rows-only checks)
ROUNDS = 20      # of the tier's 200 rounds and trees; README has the time of a round


def _tier1(spark, sf):
    """Tier 1's learners at their published rate, shares, penalties and booster depth of 7, with
    ``ROUNDS`` rounds and trees (forests to depth 7).  Rows and features are the whole ones."""
    from seriescast.plans.tiers import quick
    from seriescast.plans.train import train_evaluate
    obs, t = observations_long(spark, sf, "supp"), quick(TIERS[1], trees=ROUNDS, depth=7)
    return obs, t, train_evaluate(obs, t)


def q_ml03_06_tier1_models(spark, sf):
    """ML3/ML4/ML7/ML9/ML16: tier-1 learners (``ROUNDS`` trees) of every parameter, the fixed
    blend and the choice; metrics of every candidate."""
    _, _, res = _tier1(spark, sf)
    chosen = res.choice.select("param", F.col("chosen_model").alias("model"), F.lit(True).alias("chosen"))
    out = res.all_metrics.join(chosen, ["param", "model"], "left").fillna(False, subset=["chosen"])
    return normalise(out.select("param", "model", "chosen", "n", "rmse", "mae", "r2", "tight_pct"), SIG6)


def q_ml13_ridge_stack(spark, sf):
    """ML13 on the baseline candidates: ridge (alpha 1) coefficients per parameter."""
    return normalise(E.ridge_fit(_cands_once(spark, sf), ["param"], EV.BASE_MODELS, alpha=1.0))


def q_ml15_cv_stack(spark, sf):
    """ML15 + AG23 on the baseline candidates: mean and std of the ridge stack's R^2 over the
    expanding time folds, every fold's ridge and test error from one aggregate."""
    scores = E.ridge_cv(time_segments(_cands_wide(spark, sf)), ["param"], EV.BASE_MODELS, alpha=1.0)
    return normalise(cv_summary(scores, ["param"]))


def q_ml09_ml11_choice_orders(spark, sf):
    """ML9 and ML11 (TK2): the choice by each tier's tie order, learners played by the baseline
    candidates.  Scores are rounded to a tenth first, so that ties do occur."""
    met = reused(regression_metrics(_all_models(spark, sf), ["param", "model"]).withColumn("r2", F.round("r2", 1)))
    met = met.replace({"weighted": "blend", "persistence": "gbt_a", "roll7": "rf"}, subset=["model"])
    one = E.choose(met, ["param"], list(TIERS[1].choice_order))
    three = E.choose(met.replace({"blend": "stack", "climatology": "extra"}, subset=["model"]), ["param"],
                     list(TIERS[3].choice_order))
    return normalise(one.select("param", F.col("chosen_model").alias("tier1")).join(
        three.select("param", F.col("chosen_model").alias("tier3"), "chosen_score"), "param"))


def _yesterday(spark, sf, hold: bool = False) -> tuple[DataFrame, list[str], DataFrame]:
    """Site days with every parameter and, as features, its value of the day before (``prev_<P>``); the names of
    these, and the days, persisted with ``hold`` (for several passes: yesterday's values are read from them again)."""
    days = EV.days_series(spark, sf, S, batches=True)
    held = EV.cleaned_days(spark, sf, days)
    held = held if days.batches else EV.blocked_days(held, days, 1)
    held = reused(held) if hold else held
    if days.batches:
        wide = R.trailing_days(held, days, [{"prev": R.lag_bfill("value", 1)}], PARAMS).withColumnsRenamed({f"{p}prev": f"prev_{p}" for p in PARAMS})
    else:
        wide = R.trailing(held, days, [{f"prev_{p}": R.lag_bfill(p, 1) for p in PARAMS}], halo=1)
    return wide.select("site", "ts", *PARAMS, *[f"prev_{p}" for p in PARAMS]), [f"prev_{p}" for p in PARAMS], held


def q_ml03_boosted_tree(spark, sf):
    """ML3 / ML5: the first boosted tree of every parameter (L1 and L2, two levels, equal-width bins)
    over all rows, fitted together: each node's split, its gain, rows and leaf value."""
    wide, feats, held = _yesterday(spark, sf, hold=True)
    model = H.fit_boosted(wide, feats, PARAMS, ["site", "ts"], H.TreeSettings(
        trees=1, depth=2, rate=0.05, l1=0.05, l2=1.0, bins=16, cuts="width"), reread=True)
    held.unpersist()
    rows = [(PARAMS[t.target], i, PARAMS[t.feature[i]] if t.feature[i] >= 0 else None,
             int(t.cut[i]) if t.feature[i] >= 0 else None, float(t.gain[i]), int(t.weight[i]), float(t.value[i]))
            for t in model.trees for i in range(min(3, len(t.feature)))]
    out = spark.createDataFrame(rows, "param string, node int, feature string, cut int, gain double, n long, leaf double")
    return normalise(out, {"gain": "g6", "leaf": "g6"})


def q_ml06_random_cut_forest(spark, sf):
    """ML6: a small forest with random cuts per node, grown for all parameters at once on the train
    rows; accuracy on the test rows."""
    wide, feats, _ = _yesterday(spark, sf)
    wide = wide.withColumn("split", EV.split_col("ts"))
    model = H.fit_forest(wide.where("split = 'train'"), feats, PARAMS, ["site", "ts"], H.TreeSettings(
        trees=8, depth=6, l2=0.0, bins=64, random_cuts=True, bootstrap=True, cols_node=0.32))
    known = {p: f"actual_{p}" for p in PARAMS}      # carried along with the predictions: a day's rows meet without a join
    test = wide.where("split = 'test'").withColumnsRenamed(known)
    pred = EV.by_param(model.predict(test, ["site", "ts", *known.values()]), columns={"actual": "actual_{p}", "predicted": "{p}"})
    met = regression_metrics(pred, ["param"], train_mean=None)
    return normalise(met.select("param", "n", "rmse", "mae", "r2"))


def q_ml17_forecast_models(spark, sf):
    """ML17 with trained models: next-year forecast of the tier-1 chosen models, and the
    gate's verdict on them (AG13; ``forecast`` itself gives none when the gate refuses)."""
    from seriescast.plans.forecast import forecast, gate
    obs, t, res = _tier1(spark, sf)
    out = forecast(obs, res, t, force=True)
    return normalise(_day(out.withColumn("forecast_allowed", F.lit(gate(res)))))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
