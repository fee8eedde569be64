"""DuckDB oracle SQL for the registered queries (the driver's correctness gate).

Written directly in SQL over the driver's views, with whole-series windows:
an independent check of the blocked Spark operators.  ``_norm`` mirrors
``catalog.normalise``: ISO date strings, bigint integers, rounded doubles.
"""

from __future__ import annotations

from seriescast.config import PARAMS, RANGE_LABELS
from seriescast.plans.tiers import TIERS, Tier

WINDOWS = [3, 7, 14, 30, 60, 90]
LAGS = [1, 2, 3, 7, 14, 30, 60, 90, 365]
DIFFS = [1, 7, 14, 30]
SPANS = [7, 14, 30, 60]
DBL = "::DOUBLE"


def _norm(body: str, spec: str, digits: int = 4) -> str:
    """``spec``: ``name:kind`` items; kinds s (string), d (date), t (timestamp), i (int),
    f (double, rounded to ``digits``) or fN (rounded to N)."""
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        q = f'"{name}"'
        if kind == "s":
            cols.append(f"CAST({q} AS VARCHAR) AS {q}")
        elif kind == "d":
            cols.append(f"strftime({q}, '%Y-%m-%d') AS {q}")
        elif kind == "t":
            cols.append(f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}")
        elif kind == "i":
            cols.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "b":
            cols.append(f"{q}")
        elif kind.startswith("k"):
            n = 2 ** int(kind[1:])
            cols.append(f"round(CAST({q} AS DOUBLE) * {n}.0) / {n}.0 + 0.0 AS {q}")
        elif kind.startswith("g"):
            n = int(kind[1:])
            x = f"CAST({q} AS DOUBLE)"
            k = f"({n - 1} - CAST(floor(log10(abs({x}))) AS INTEGER))"
            cols.append(f"CASE WHEN {q} IS NULL OR {q} = 0 THEN {x} "
                        f"WHEN {k} >= 0 THEN round({x} * pow(10, {k})) / pow(10, {k}) "
                        f"ELSE round({x} / pow(10, -{k})) * pow(10, -{k}) END + 0.0 AS {q}")
        elif kind.startswith("f"):
            n = int(kind[1:]) if len(kind) > 1 else digits
            cols.append(f"round(CAST({q} AS DOUBLE) * {10 ** n}.0) / {10 ** n}.0 + 0.0 AS {q}")
        else:
            raise ValueError(kind)
    return f"WITH {body}\nSELECT {', '.join(cols)} FROM final"


SPLIT = "CASE WHEN ts < DATE '2000-01-01' THEN 'train' ELSE 'test' END"


def _obs(grain: str = "supp", by_split: bool = False) -> str:
    """The derived observations; ``by_split`` names a site's two halves ``<site>/train`` and
    ``<site>/test``, so that every later window restarts at the cut."""
    site = "CAST(l_suppkey AS VARCHAR)" if grain == "supp" else "l_returnflag"
    exprs = {
        "ALLSKY_SFC_SW_DWN": "allsky",
        "ALLSKY_SFC_SW_DNI": f"sqrt(price / cnt) * 0.0312873{DBL}",
        "ALLSKY_SFC_SW_DIFF": f"sqrt(cnt) * 0.4817293{DBL} + 0.2236068{DBL}",
        "CLRSKY_SFC_SW_DWN": "clear",
        "T2M": f"sqrt(tax) * 123.456789{DBL} - 4.9137{DBL}",
        "RH2M": f"sqrt(disc) * 285.71429{DBL} + 5.1371{DBL}",
        "WS2M": f"abs(sqrt(disc) - sqrt(tax)) * 37.947332{DBL}",
        "PRECTOTCORR": f"CASE WHEN disc > 0.05{DBL} THEN sqrt(disc - 0.05{DBL}) * 89.442719{DBL} ELSE 0.0{DBL} END",
        "PS": f"sqrt(tax) * 56.568542{DBL} + 84.9137{DBL}",
        "ALLSKY_KT": "allsky / clear",
    }
    cols = ",\n    ".join(
        f"CASE WHEN (dn + {i}) % 13 = 0 THEN -999.0{DBL} ELSE {exprs[p]} END AS {p}"
        for i, p in enumerate(PARAMS))
    return f"""
li AS (
  SELECT {site} AS site, CAST(l_shipdate AS DATE) AS ts, count(*) AS cnt,
         sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price,
         round(sum(l_discount), 2) AS dsum, round(sum(l_tax), 2) AS tsum
  FROM lineitem GROUP BY 1, 2),
lw AS (
  SELECT site, ts, cnt, price, dsum / cnt AS disc, tsum / cnt AS tax,
         sqrt(qty / cnt) * 0.91372941{DBL} + 0.3119537{DBL} AS allsky,
         date_diff('day', DATE '1995-01-01', ts) AS dn
  FROM li),
lw2 AS (SELECT *, allsky + 1.7320508{DBL} + sqrt(cnt) * 0.1414213{DBL} AS clear FROM lw),
wide AS (
  SELECT {f"site || '/' || {SPLIT} AS site" if by_split else "site"}, ts,
    {cols}
  FROM lw2),
long AS (SELECT * FROM (UNPIVOT wide ON {", ".join(PARAMS)} INTO NAME param VALUE value))"""


CLEAN = """,
raw AS (SELECT site, param, ts, CASE WHEN value = -999 THEN NULL ELSE value END AS v FROM long),
idx AS (SELECT *, row_number() OVER (PARTITION BY site, param ORDER BY ts) AS rn,
               count(*) OVER (PARTITION BY site, param) AS n FROM raw),
nb AS (
  SELECT *,
    last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER wf AS pr,
    last_value(v IGNORE NULLS) OVER wf AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER wn AS nr,
    first_value(v IGNORE NULLS) OVER wn AS nv
  FROM idx
  WINDOW wf AS (PARTITION BY site, param ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wn AS (PARTITION BY site, param ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
clean AS (
  SELECT site, param, ts, rn, n,
    CASE WHEN v IS NOT NULL THEN v WHEN pr IS NULL THEN nv WHEN nr IS NULL THEN pv
         ELSE ((nv - pv) / (nr - pr)) * (rn - pr) + pv END AS value
  FROM nb)"""

W = "PARTITION BY site, param ORDER BY rn"


def _frame(k: int) -> str:
    return f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _sweep(col: str, part: str = "site, param") -> str:
    """WN16 on one column: non-finite -> null, then back-fill, forward-fill, 0."""
    c = f"CASE WHEN isfinite({col}) THEN {col} END"
    return (f"coalesce({c}, first_value({c} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY rn "
            f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
            f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY rn "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)")


def _feat(select: str, names: list[str], digits: int = 4, extra: str = "") -> str:
    body = _obs() + CLEAN + f""",
{extra}final AS (SELECT site, param, ts AS day, {select} FROM clean)"""
    spec = "site:s param:s day:d " + " ".join(f"{n}:f" for n in names)
    return _norm(body, spec, digits)


def q_src_observations_long() -> str:
    body = _obs() + """,
final AS (SELECT site, param, ts AS day, CASE WHEN value = -999 THEN NULL ELSE value END AS value FROM long)"""
    return _norm(body, "site:s param:s day:d value:f")


def q_src1_daily_csv() -> str:
    def cell(i: int, p: str) -> str:
        gone = " OR ".join(f"(date_diff('day', DATE '1995-01-01', ts) + {i}) % {m} = 0" for m in (13, 17, 19, 23))
        return f"CASE WHEN {gone} THEN NULL ELSE {p} END AS {p}"
    body = _obs() + f""",
final AS (SELECT site, ts AS day, year(ts) AS "YEAR", month(ts) AS "MO", day(ts) AS "DY",
                 {", ".join(cell(i, p) for i, p in enumerate(PARAMS))} FROM wide)"""
    return _norm(body, "site:s day:d YEAR:i MO:i DY:i " + " ".join(f"{p}:f" for p in PARAMS))


def q_src2_predictions_csv() -> str:
    body = PRED + """,
final AS (SELECT site, param, ts AS day, model, actual, predicted, actual - predicted AS error,
                 (actual - predicted) / (abs(actual) + 1e-10) * 100 AS percent_error
          FROM cands WHERE model = 'persistence')"""
    return _norm(body, "site:s param:s day:d model:s actual:f predicted:f error:f percent_error:g6")


def q_snk1_metrics_csv() -> str:
    body = PRED + CHOSEN + """,
final AS (SELECT m.param AS parameter, m.model, mse, rmse, mae, r2, variance, mape, improvement,
                 tight_pct AS tight_range_accuracy
          FROM met m JOIN pick p ON m.param = p.param AND m.model = p.chosen_model)"""
    return _norm(body, "parameter:s model:s mse:f rmse:f mae:f r2:f variance:f mape:g6 improvement:f "
                       "tight_range_accuracy:f")


def _wide_file(src: str, what: str, suffix: str, kind: str) -> str:
    cols = ", ".join(f"max(CASE WHEN param = '{p}' THEN {what} END) AS \"{p}_{suffix}\"" for p in PARAMS)
    body = src + f""",
final AS (SELECT site, year(ts) AS "YEAR", month(ts) AS "MO", day(ts) AS "DY", ts AS day, {cols}
          FROM rows_ GROUP BY site, ts)"""
    return _norm(body, "site:s YEAR:i MO:i DY:i day:d " + " ".join(f"{p}_{suffix}:{kind}" for p in PARAMS))


def q_snk3_forecast_csv() -> str:
    src = FORECAST + ",\nrows_ AS (SELECT site, param, day AS ts, predicted FROM fc)"
    return _wide_file(src, "predicted", "PREDICTED", "f")


def q_snk4_variance_csv() -> str:
    src = PRED + """,
rows_ AS (SELECT site, param, ts, (actual - predicted) / (predicted + 1e-10) AS ratio
          FROM cands WHERE model = 'climatology')"""
    return _wide_file(src, "ratio", "VARIANCE", "g6")


def q_snk5_breakdown_csv() -> str:
    return q_ag14_15_range_breakdown()


def q_src5_forecast_calendar() -> str:
    body = _obs() + """,
nxt AS (SELECT site, year(max(ts)) + 1 AS fy FROM wide GROUP BY site),
cal AS (SELECT site, CAST(unnest(generate_series(make_date(fy, 1, 1), make_date(fy, 12, 31),
               INTERVAL 1 DAY)) AS DATE) AS day FROM nxt),
final AS (SELECT site, day, year(day) AS "YEAR", month(day) AS "MO", day(day) AS "DY" FROM cal)"""
    return _norm(body, "site:s day:d YEAR:i MO:i DY:i")


def q_src5_calendar_gap_fill() -> str:
    body = """
pr AS (SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS ts,
              round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
bounds AS (SELECT site, min(ts) AS lo, max(ts) AS hi FROM pr GROUP BY site),
cal AS (SELECT site, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM bounds),
full_ AS (SELECT c.site, c.ts, p.value AS v FROM cal c LEFT JOIN pr p ON c.site = p.site AND c.ts = p.ts),
idx AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS rn FROM full_),
nb AS (
  SELECT *,
    last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER wf AS pr_,
    last_value(v IGNORE NULLS) OVER wf AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER wn AS nr,
    first_value(v IGNORE NULLS) OVER wn AS nv
  FROM idx
  WINDOW wf AS (PARTITION BY site ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wn AS (PARTITION BY site ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
final AS (
  SELECT site, ts AS day, v AS raw,
    CASE WHEN v IS NOT NULL THEN v WHEN pr_ IS NULL THEN nv WHEN nr IS NULL THEN pv
         ELSE ((nv - pv) / (nr - pr_)) * (rn - pr_) + pv END AS value
  FROM nb)"""
    return _norm(body, "site:s day:d raw:f value:f")


def q_wn14_interpolate() -> str:
    return _feat("value", ["value"])


def q_wn01_rolling_mean() -> str:
    names = [f"v_rolling_{k}" for k in WINDOWS]
    sel = ", ".join(f"avg(value) OVER {_frame(k)} AS v_rolling_{k}" for k in WINDOWS)
    return _feat(sel, names)


def q_wn02_rolling_std() -> str:
    names = [f"v_rolling_std_{k}" for k in WINDOWS]
    sel = ", ".join(f"coalesce(stddev_samp(value) OVER {_frame(k)}, 0.0) AS v_rolling_std_{k}" for k in WINDOWS)
    return _feat(sel, names)


def q_wn03_rolling_min_max() -> str:
    names, sel = [], []
    for k in WINDOWS:
        names += [f"v_rolling_min_{k}", f"v_rolling_max_{k}"]
        sel += [f"min(value) OVER {_frame(k)} AS v_rolling_min_{k}",
                f"max(value) OVER {_frame(k)} AS v_rolling_max_{k}"]
    return _feat(", ".join(sel), names)


def _moment(kind: str) -> str:
    ks = [k for k in WINDOWS if k >= 7]
    names, sel = [], []
    for k in ks:
        f = _frame(k)
        if kind == "skew":
            names.append(f"v_rolling_skew_{k}")
            sel.append(f"CASE WHEN count(value) OVER {f} < 3 THEN 0.0 "
                       f"WHEN max(value) OVER {f} = min(value) OVER {f} THEN 0.0 "
                       f"ELSE coalesce(skewness(value - smean) OVER {f}, 0.0) END AS v_rolling_skew_{k}")
        else:
            names.append(f"v_rolling_kurt_{k}")
            sel.append(f"CASE WHEN count(value) OVER {f} < 4 THEN 0.0 "
                       f"WHEN max(value) OVER {f} = min(value) OVER {f} THEN -3.0 "
                       f"ELSE coalesce(kurtosis(value - smean) OVER {f}, 0.0) END AS v_rolling_kurt_{k}")
    body = _obs() + CLEAN + f""",
cm AS (SELECT *, avg(value) OVER (PARTITION BY site, param) AS smean FROM clean),
final AS (SELECT site, param, ts AS day, {", ".join(sel)} FROM cm)"""
    return _norm(body, "site:s param:s day:d " + " ".join(f"{n}:k10" for n in names))


def q_wn04_rolling_skew() -> str:
    return _moment("skew")


def q_wn05_rolling_kurt() -> str:
    return _moment("kurt")


def q_wn06_rain_rolling_sum() -> str:
    body = _obs() + CLEAN + f""",
final AS (SELECT site, ts AS day, sum(value) OVER {_frame(7)} AS precip_cumsum_7,
                 sum(value) OVER {_frame(30)} AS precip_cumsum_30
          FROM clean WHERE param = 'PRECTOTCORR')"""
    return _norm(body, "site:s day:d precip_cumsum_7:f precip_cumsum_30:f")


def q_wn07_lags() -> str:
    names = [f"v_lag_{k}" for k in LAGS]
    sel = ", ".join(f"coalesce(lag(value, {k}) OVER ({W}), CASE WHEN n > {k} THEN "
                    f"first_value(value) OVER ({W}) END) AS v_lag_{k}" for k in LAGS)
    return _feat(sel, names)


def q_wn08_diffs() -> str:
    names = [f"v_diff_{k}" for k in DIFFS]
    sel = ", ".join(f"coalesce(value - lag(value, {k}) OVER ({W}), 0.0) AS v_diff_{k}" for k in DIFFS)
    return _feat(sel, names)


def q_wn09_pressure_tendency() -> str:
    body = _obs() + CLEAN + f""",
t AS (SELECT site, ts, rn, value - lag(value, 3) OVER (PARTITION BY site ORDER BY rn) AS d3,
             value - lag(value, 7) OVER (PARTITION BY site ORDER BY rn) AS d7
      FROM clean WHERE param = 'PS'),
final AS (SELECT site, ts AS day, {_sweep("d3", "site")} AS pressure_tendency_3day,
                 {_sweep("d7", "site")} AS pressure_tendency_7day FROM t)"""
    return _norm(body, "site:s day:d pressure_tendency_3day:f pressure_tendency_7day:f")


def q_wn10_pct_change() -> str:
    raw = []
    for k in DIFFS:
        lg = f"lag(value, {k}) OVER ({W})"
        raw.append(f"CASE WHEN {lg} IS NULL OR ({lg} = 0 AND value = 0) THEN 0.0 "
                   f"WHEN {lg} = 0 THEN NULL ELSE value / {lg} - 1 END AS p{k}")
    names = [f"v_diff_pct_{k}" for k in DIFFS]
    body = _obs() + CLEAN + f""",
p AS (SELECT site, param, ts, rn, {", ".join(raw)} FROM clean),
final AS (SELECT site, param, ts AS day, {", ".join(f"{_sweep(f'p{k}')} AS v_diff_pct_{k}" for k in DIFFS)} FROM p)"""
    return _norm(body, "site:s param:s day:d " + " ".join(f"{n}:f" for n in names))


def q_wn11_diff_rolling() -> str:
    body = _obs() + CLEAN + f""",
d1 AS (SELECT site, param, ts, rn, coalesce(value - lag(value, 1) OVER ({W}), 0.0) AS diff_1 FROM clean),
final AS (SELECT site, param, ts AS day, avg(diff_1) OVER {_frame(7)} AS v_diff_rolling_7,
                 avg(diff_1) OVER {_frame(30)} AS v_diff_rolling_30 FROM d1)"""
    return _norm(body, "site:s param:s day:d v_diff_rolling_7:f v_diff_rolling_30:f")


def q_wn12_13_ewm() -> str:
    names = [f"ewm_{s}" for s in SPANS] + [f"ewm_std_{s}" for s in SPANS]
    body = "RECURSIVE " + (_obs() + CLEAN).lstrip() + _ewm_sql(SPANS, True) + f""",
final AS (SELECT site, param, ts AS day, {", ".join(f"{n} AS v_{n}" for n in names)}
          FROM ew JOIN clean USING (site, param, rn))"""
    return _norm(body, "site:s param:s day:d " + " ".join(f"v_{n}:f3" for n in names))


def q_wn17_18_spells() -> str:
    body = _obs() + CLEAN + """,
r AS (SELECT site, ts, rn, coalesce(value > 0, false) AS wet FROM clean WHERE param = 'PRECTOTCORR'),
l AS (SELECT *, max(CASE WHEN wet THEN rn END) OVER (PARTITION BY site ORDER BY rn) AS lw,
                max(CASE WHEN NOT wet THEN rn END) OVER (PARTITION BY site ORDER BY rn) AS ld FROM r),
final AS (SELECT site, ts AS day,
                 CASE WHEN wet THEN 0 ELSE rn - coalesce(lw, 0) END AS dry_spell_length,
                 CASE WHEN NOT wet THEN 0 ELSE rn - coalesce(ld, 0) END AS wet_spell_length FROM l)"""
    return _norm(body, "site:s day:d dry_spell_length:i wet_spell_length:i")


def q_ag24_wn19_seasonal() -> str:
    body = _obs() + CLEAN + """,
s AS (SELECT *, avg(value) OVER (PARTITION BY site, param, dayofyear(ts)) AS v_yearly_avg,
                avg(value) OVER (PARTITION BY site, param, month(ts)) AS v_monthly_avg FROM clean),
final AS (SELECT site, param, ts AS day, v_yearly_avg, v_monthly_avg,
                 value - v_yearly_avg AS v_deviation_from_yearly,
                 value - v_monthly_avg AS v_deviation_from_monthly FROM s)"""
    return _norm(body, "site:s param:s day:d v_yearly_avg:f v_monthly_avg:f "
                       "v_deviation_from_yearly:f v_deviation_from_monthly:f")


def q_wn01_hourly_rolling() -> str:
    body = """
h AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, sqrt(round(sum(value), 2)) AS value
      FROM events GROUP BY 1, 2),
final AS (SELECT site, ts, value,
   avg(value) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3,
   avg(value) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rolling_24,
   coalesce(stddev_samp(value) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0.0)
     AS rolling_std_24
   FROM h)"""
    return _norm(body, "site:s ts:t value:f rolling_3:f rolling_24:f rolling_std_24:f")


def _calendar(ts: str) -> dict[str, str]:
    """CAL1-CAL13 on the date ``ts``."""
    lat, tp = 29.92, "(2 * pi())"
    doy, month, week = f"dayofyear({ts})", f"month({ts})", f"week({ts})"
    dec = f"(23.45 * sin({tp} * ({doy} - 81) / 365.25))"
    x = f"(-tan(radians({lat})) * tan(radians({dec})))"
    return {
        "day_of_year": doy, "month": month, "day": f"day({ts})", "week_of_year": week,
        "quarter": f"quarter({ts})", "is_weekend": f"CAST(isodow({ts}) IN (6, 7) AS INTEGER)",
        "day_sin": f"sin({tp} * {doy} / 365.25)", "day_cos": f"cos({tp} * {doy} / 365.25)",
        "month_sin": f"sin({tp} * {month} / 12)", "month_cos": f"cos({tp} * {month} / 12)",
        "week_sin": f"sin({tp} * {week} / 52)", "week_cos": f"cos({tp} * {week} / 52)",
        "season": f"CAST(floor(({month} % 12) / 3) AS INTEGER)",
        "is_summer": f"CAST({month} IN (6, 7, 8) AS INTEGER)",
        "is_winter": f"CAST({month} IN (12, 1, 2) AS INTEGER)",
        "is_monsoon": f"CAST({month} IN (7, 8, 9) AS INTEGER)",
        "is_spring": f"CAST({month} IN (3, 4, 5) AS INTEGER)",
        "is_autumn": f"CAST({month} IN (10, 11) AS INTEGER)",
        "day_length_hours": f"CASE WHEN abs({x}) <= 1 THEN 2 * acos({x}) * 24 / {tp} END",
        "solar_noon_altitude": f"90 - {lat} + {dec}",
    }


FIRST_YEAR = """,
fy AS (SELECT site, arg_min(year(ts), ts) AS fy FROM wide GROUP BY site)"""


def q_cal_features() -> str:
    cal = ", ".join(f"{x} AS {k}" for k, x in _calendar("w.ts").items())
    body = _obs() + FIRST_YEAR + f""",
final AS (
  SELECT w.site, w.ts AS date, {cal},
    date_diff('day', make_date(f.fy, 1, 1), w.ts) AS days_since_year_start,
    date_diff('day', w.ts, make_date(f.fy, 12, 31)) AS days_until_year_end
  FROM wide w JOIN fy f ON w.site = f.site)"""
    spec = ("site:s date:d day_of_year:i month:i day:i week_of_year:i quarter:i is_weekend:i "
            "day_sin:f day_cos:f month_sin:f month_cos:f week_sin:f week_cos:f season:i is_summer:i "
            "is_winter:i is_monsoon:i is_spring:i is_autumn:i day_length_hours:f solar_noon_altitude:f "
            "days_since_year_start:i days_until_year_end:i")
    return _norm(body, spec)


PHYSICS = """,
cw AS (PIVOT (SELECT site, ts, param, value FROM clean) ON param IN ({params}) USING first(value)),
b AS (SELECT *, T2M AS T, RH2M AS RH, WS2M AS W, PS AS P,
             6.112 * exp((17.67 * T2M) / (T2M + 243.5)) AS es FROM cw),
c AS (SELECT *, es * (RH / 100.0) AS ea, T * 9 / 5 + 32 AS tf, W * 3.6 AS vk FROM b),
d AS (SELECT *, CASE WHEN 101.325 - ea = 0 THEN NULL ELSE (0.622 * ea) / (101.325 - ea) END AS hr,
             (17.27 * T) / (237.7 + T) + CASE WHEN RH / 100.0 > 0 THEN ln(RH / 100.0) END AS alpha FROM c),
e AS (SELECT *, ((P * 1000) / (287.05 * (T + 273.15))) / (1 + 0.608 * hr) AS rho FROM d),
phy AS (SELECT site, ts,
  ((-42.379 + 2.04901523 * tf + 10.14333127 * RH - 0.22475541 * tf * RH - 0.00683783 * tf * tf
    - 0.05481717 * RH * RH + 0.00122874 * tf * tf * RH + 0.00085282 * tf * RH * RH
    - 0.00000199 * tf * tf * RH * RH) - 32) * 5 / 9 AS heat_index_advanced,
  CASE WHEN 17.27 - alpha = 0 THEN NULL ELSE (237.7 * alpha) / (17.27 - alpha) END AS dew_point,
  es AS saturation_vapor_pressure, ea AS actual_vapor_pressure, es - ea AS vapor_pressure_deficit,
  hr AS humidity_ratio,
  CASE WHEN T < 10 THEN 13.12 + 0.6215 * T - 11.37 * pow(vk, 0.16) + 0.3965 * T * pow(vk, 0.16) ELSE T END
    AS wind_chill_advanced,
  rho AS air_density, 0.5 * rho * pow(W, 3) AS wind_power_density,
  CAST(W < 0.3 AS INTEGER) AS wind_calm, CAST(W >= 3.4 AND W < 7.9 AS INTEGER) AS wind_moderate,
  CAST(W >= 10.8 AS INTEGER) AS wind_strong,
  CLRSKY_SFC_SW_DWN - ALLSKY_SFC_SW_DWN AS cloud_effect,
  ALLSKY_SFC_SW_DWN / (CLRSKY_SFC_SW_DWN + 1e-10) AS cloud_ratio,
  CAST(PRECTOTCORR > 0 AS INTEGER) AS precip_binary,
  T * RH * W AS temp_humidity_wind, T * P AS temp_pressure_interaction, RH * W AS humidity_wind_interaction,
  ALLSKY_SFC_SW_DWN * T * (RH / 100) AS solar_temp_humidity,
  T * RH AS temp_humidity_interaction, T + 0.5 * RH AS heat_index, T - W * 0.5 AS wind_chill,
  ALLSKY_SFC_SW_DWN * T AS solar_temp_interaction,
  CASE WHEN T + 273.15 = 0 THEN NULL ELSE P / (T + 273.15) END AS pressure_temp_ratio
  FROM e)""".replace("{params}", ", ".join(f"'{p}'" for p in PARAMS))


def q_ph_features() -> str:
    body = _obs() + CLEAN + PHYSICS + ",\nfinal AS (SELECT *, ts AS day FROM phy)"
    spec = ("site:s day:d heat_index_advanced:f dew_point:f saturation_vapor_pressure:f "
            "actual_vapor_pressure:f vapor_pressure_deficit:f humidity_ratio:f wind_chill_advanced:f "
            "air_density:f wind_power_density:f wind_calm:i wind_moderate:i wind_strong:i cloud_effect:f "
            "cloud_ratio:f precip_binary:i temp_humidity_wind:f temp_pressure_interaction:f "
            "humidity_wind_interaction:f solar_temp_humidity:f temp_humidity_interaction:f heat_index:f "
            "wind_chill:f solar_temp_interaction:f pressure_temp_ratio:f")
    return _norm(body, spec)


# ------------------------------------------------------------------ tier matrices
def _ewm_sql(spans, std: bool) -> str:
    """WN12 / WN13 along every series: CTE ``rec`` with ``ewm_<span>`` (and ``ewm_std_<span>``)."""
    init, step, out = [], [], []
    for s in spans:
        a = 2.0 / (s + 1.0)
        r = 1.0 - a
        init += [f"value AS m{s}", f"0.0{DBL} AS v{s}", f"1.0{DBL} AS q{s}"]
        step += [f"r.m{s} + {a!r} * (e.value - r.m{s}) AS m{s}",
                 f"{r!r} * (r.v{s} + {a!r} * (e.value - r.m{s}) * (e.value - r.m{s})) AS v{s}",
                 f"{r!r} * {r!r} * r.q{s} + {a!r} * {a!r} AS q{s}"]
        out.append(f"m{s} AS ewm_{s}")
        if std:
            out.append(f"CASE WHEN rn = 1 OR q{s} >= 1 THEN 0.0 ELSE sqrt(v{s} / (1 - q{s})) END AS ewm_std_{s}")
    return f""",
rec AS (
  SELECT site, param, rn, {", ".join(init)} FROM clean WHERE rn = 1
  UNION ALL
  SELECT e.site, e.param, e.rn, {", ".join(step)}
  FROM rec r JOIN clean e ON e.site = r.site AND e.param = r.param AND e.rn = r.rn + 1),
ew AS (SELECT site, param, rn, {", ".join(out)} FROM rec)"""


def _param_features(t: Tier) -> tuple[dict[str, str], dict[str, str]]:
    """Per-parameter columns of a tier: over ``cm`` (clean rows), and over ``f1`` (their results)."""
    one, two = {}, {}
    plain = {"mean": ("rolling", "avg(value) OVER {f}"),
             "std": ("rolling_std", "coalesce(stddev_samp(value) OVER {f}, 0.0)"),
             "min": ("rolling_min", "min(value) OVER {f}"), "max": ("rolling_max", "max(value) OVER {f}"),
             "skew": ("rolling_skew",
                      "CASE WHEN count(value) OVER {f} < 3 OR max(value) OVER {f} = min(value) OVER {f} THEN 0.0 "
                      "ELSE coalesce(skewness(value - smean) OVER {f}, 0.0) END"),
             "kurt": ("rolling_kurt",
                      "CASE WHEN count(value) OVER {f} < 4 THEN 0.0 WHEN max(value) OVER {f} = min(value) OVER {f} "
                      "THEN -3.0 ELSE coalesce(kurtosis(value - smean) OVER {f}, 0.0) END")}
    pairs = [(st, k) for k in t.windows for st in t.stats if k >= 7 or st not in ("skew", "kurt")]
    for st, k in pairs + list(t.extra_stats):
        label, sql = plain[st]
        one[f"{label}_{k}"] = sql.replace("{f}", _frame(k))
    for k in t.lags:
        lag = (f"coalesce(lag(value, {k}) OVER ({W}), CASE WHEN n > {k} THEN first_value(value) OVER ({W}) END"
               f"{', 0.0' if t.physics else ''})")
        one[f"lag_{k}"] = lag
    for k in t.diffs:
        one[f"diff_{k}"] = f"coalesce(value - lag(value, {k}) OVER ({W}), 0.0)"
    for k in t.pct_diffs:
        lg = f"lag(value, {k}) OVER ({W})"
        one[f"raw_pct_{k}"] = (f"CASE WHEN {lg} IS NULL OR ({lg} = 0 AND value = 0) THEN 0.0 "
                               f"WHEN {lg} = 0 THEN NULL ELSE value / {lg} - 1 END")
        two[f"diff_pct_{k}"] = _sweep(f"raw_pct_{k}")
    for k in t.diff_rolling:
        two[f"diff_rolling_{k}"] = f"avg(diff_1) OVER {_frame(k)}"
    if t.seasonal:
        for lab, fn in (("yearly", "dayofyear"), ("monthly", "month")):
            avg = f"avg(value) OVER (PARTITION BY site, param, {fn}(ts))"
            one[f"{lab}_avg"] = avg
            one[f"deviation_from_{lab}"] = f"value - {avg}"
    return one, two


# tier 3's columns per site and day, besides those of ``phy``
SITE_DAY = f""",
psd AS (SELECT site, ts, value - lag(value, 3) OVER (PARTITION BY site ORDER BY rn) AS pressure_tendency_3day,
               value - lag(value, 7) OVER (PARTITION BY site ORDER BY rn) AS pressure_tendency_7day
        FROM clean WHERE param = 'PS'),
kt AS (SELECT site, ts, avg(value) OVER {_frame(7)} AS clearness_index_rolling_7,
              coalesce(stddev_samp(value) OVER {_frame(7)}, 0.0) AS clearness_index_std_7
       FROM clean WHERE param = 'ALLSKY_KT'),
rr AS (SELECT site, ts, rn, coalesce(value > 0, false) AS wet, sum(value) OVER {_frame(7)} AS precip_cumsum_7,
              sum(value) OVER {_frame(30)} AS precip_cumsum_30
       FROM clean WHERE param = 'PRECTOTCORR'),
rl0 AS (SELECT *, max(CASE WHEN wet THEN rn END) OVER (PARTITION BY site ORDER BY rn) AS lw,
                 max(CASE WHEN NOT wet THEN rn END) OVER (PARTITION BY site ORDER BY rn) AS ld FROM rr),
rain AS (SELECT *, CASE WHEN wet THEN 0 ELSE rn - coalesce(lw, 0) END AS dry_spell_length,
                CASE WHEN NOT wet THEN 0 ELSE rn - coalesce(ld, 0) END AS wet_spell_length FROM rl0),
sd0 AS (SELECT * FROM phy JOIN psd USING (site, ts) JOIN kt USING (site, ts) JOIN rain USING (site, ts)
                     JOIN fy USING (site))"""


def _tier_matrix(t: Tier) -> str:
    one, two = _param_features(t)
    per = list(one) + list(two)
    joins = ""
    body = "RECURSIVE " + (_obs(by_split=True) + CLEAN).lstrip()
    if t.ewm_spans:
        body += _ewm_sql(t.ewm_spans, t.ewm_std)
        joins = "JOIN ew USING (site, param, rn)"
        per += [f"ewm_{s}" for s in t.ewm_spans] + [f"ewm_std_{s}" for s in t.ewm_spans if t.ewm_std]
    per = [c for c in per if not c.startswith("raw_pct_")]
    body += f""",
cm AS (SELECT *, avg(value) OVER (PARTITION BY site, param) AS smean FROM clean),
f1 AS (SELECT site, param, ts, rn, value, {", ".join(f"{x} AS {k}" for k, x in one.items())} FROM cm),
f2 AS (SELECT *{"".join(f", {x} AS {k}" for k, x in two.items())} FROM f1),
ft AS (SELECT * FROM f2 {joins})"""
    cols = {p: f"max(CASE WHEN param = '{p}' THEN value END)" for p in PARAMS}
    cols.update({f"{p}_{c}": f"max(CASE WHEN param = '{p}' THEN {c} END)" for p in PARAMS for c in per})
    body += f""",
pv AS (SELECT site, ts, {", ".join(f'{x} AS "{k}"' for k, x in cols.items())} FROM ft GROUP BY site, ts)"""
    cal = _calendar("ts")
    names = [k for k in cal if t.number >= 3 or (k not in ("is_spring", "is_autumn", "day_length_hours",
                                                          "solar_noon_altitude"))]
    if t.number == 1:
        names = [k for k in names if k not in ("is_weekend", "week_sin", "week_cos", "season", "is_summer",
                                               "is_winter", "is_monsoon")]
    sel = {k: cal[k] for k in names}
    src = "pv"
    if t.interactions:
        body += PHYSICS
        src = "pv JOIN phy USING (site, ts)"
        sel |= {k: k for k in ("temp_humidity_interaction", "heat_index", "wind_chill", "solar_temp_interaction",
                               "pressure_temp_ratio")}
    if t.physics:
        swept = ["dew_point", "humidity_ratio", "air_density", "wind_power_density", "wind_chill_advanced",
                 "pressure_tendency_3day", "pressure_tendency_7day"]
        kept = ["heat_index_advanced", "saturation_vapor_pressure", "actual_vapor_pressure",
                "vapor_pressure_deficit", "wind_calm", "wind_moderate", "wind_strong", "cloud_effect", "cloud_ratio",
                "clearness_index_rolling_7", "clearness_index_std_7", "precip_binary", "precip_cumsum_7",
                "precip_cumsum_30", "dry_spell_length", "wet_spell_length", "temp_humidity_wind",
                "temp_pressure_interaction", "humidity_wind_interaction", "solar_temp_humidity"]
        days = {"days_since_year_start": "date_diff('day', make_date(fy, 1, 1), ts)",
                "days_until_year_end": "date_diff('day', ts, make_date(fy, 12, 31))"}
        body += PHYSICS + FIRST_YEAR + SITE_DAY + f""",
sd AS (SELECT site, ts, {", ".join(kept)}, {", ".join(f"{_sweep(c, 'site')} AS {c}" for c in swept)},
              {", ".join(f"{x} AS {k}" for k, x in days.items())} FROM sd0)"""
        src = "pv JOIN sd USING (site, ts)"
        sel |= {k: k for k in [*kept, *swept, *days]}
    body += f""",
final AS (SELECT split_part(site, '/', 1) AS site, split_part(site, '/', 2) AS split, ts AS tday,
                 {", ".join(f'"{k}"' for k in cols)}, {", ".join(f'{x} AS "{k}"' for k, x in sel.items())}
          FROM {src})"""
    spec = ["site:s", "split:s"]
    for k in [*cols, *sel]:
        kind = "k10" if "_skew_" in k or "_kurt_" in k else "f3" if "_ewm_" in k else "f"
        spec.append(f"{k}:{kind}")
    return _norm(body, " ".join(spec) + " tday:d")


def q_tier1_matrix() -> str:
    return _tier_matrix(TIERS[1])


def q_tier2_matrix() -> str:
    return _tier_matrix(TIERS[2])


def q_tier3_matrix() -> str:
    return _tier_matrix(TIERS[3])


# ------------------------------------------------------------------ predictions
CANDS = CLEAN + """,
f AS (SELECT *, coalesce(lag(value, 1) OVER (PARTITION BY site, param ORDER BY rn),
                         CASE WHEN n > 1 THEN first_value(value) OVER (PARTITION BY site, param ORDER BY rn) END)
                  AS persistence,
               coalesce(avg(value) OVER (PARTITION BY site, param ORDER BY rn ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
                        value) AS roll7,
               CASE WHEN ts < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split
      FROM clean),
tm AS (SELECT site, param, avg(value) AS train_mean FROM f WHERE split = 'train' GROUP BY 1, 2),
mm AS (SELECT site, param, month(ts) AS m, avg(value) AS clim FROM f WHERE split = 'train' GROUP BY 1, 2, 3),
t AS (SELECT f.site, f.param, f.ts, f.value AS actual, f.persistence, f.roll7, tm.train_mean,
             coalesce(mm.clim, tm.train_mean) AS climatology
      FROM f LEFT JOIN tm ON f.site = tm.site AND f.param = tm.param
             LEFT JOIN mm ON f.site = mm.site AND f.param = mm.param AND month(f.ts) = mm.m
      WHERE f.split = 'test'),
cands AS (
  SELECT * FROM (
    SELECT site, param, ts, 'persistence' AS model, actual, persistence AS predicted, train_mean FROM t
    UNION ALL SELECT site, param, ts, 'roll7', actual, roll7, train_mean FROM t
    UNION ALL SELECT site, param, ts, 'climatology', actual, climatology, train_mean FROM t)
  WHERE predicted IS NOT NULL),
r2 AS (SELECT param, model,
              CASE WHEN var_pop(actual) * count(*) = 0 THEN
                     CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
                   ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END AS r2
       FROM cands GROUP BY 1, 2),
wt0 AS (SELECT r2.*, sum(r2) OVER (PARTITION BY param) AS tot FROM r2),
wt1 AS (SELECT param, model, CASE WHEN tot > 0 THEN r2 / tot ELSE 0.33 END AS w FROM wt0),
weights AS (SELECT param, model, w / sum(w) OVER (PARTITION BY param) AS weight FROM wt1),
blend AS (SELECT c.site, c.param, c.ts, 'weighted' AS model, any_value(c.actual) AS actual,
                 sum(w.weight * c.predicted) AS predicted, any_value(c.train_mean) AS train_mean
          FROM cands c JOIN weights w ON c.param = w.param AND c.model = w.model
          GROUP BY c.site, c.param, c.ts),
allm AS (SELECT * FROM cands UNION ALL SELECT * FROM blend)"""


def _metrics_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n,
      avg((actual - predicted) * (actual - predicted)) AS mse,
      sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
      avg(abs(actual - predicted)) AS mae,
      CASE WHEN var_pop(actual) * count(*) = 0 THEN
             CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
           ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END AS r2,
      var_pop(actual - predicted) AS variance,
      avg(abs((actual - predicted) / (abs(actual) + 1e-10))) * 100 AS mape,
      (avg((actual - train_mean) * (actual - train_mean)) - avg((actual - predicted) * (actual - predicted)))
        / avg((actual - train_mean) * (actual - train_mean)) * 100 AS improvement,
      count(*) FILTER (WHERE (actual - predicted) / (predicted + 1e-10) BETWEEN -0.10 AND 0.10)
        / count(*) * 100 AS tight_pct,
      avg(actual - predicted) AS mean_error, stddev_pop(actual - predicted) AS std_error,
      least(min(actual), min(predicted)) AS axis_lo, greatest(max(actual), max(predicted)) AS axis_hi
    FROM {src} GROUP BY {keys}"""


METRIC_SPEC = ("n:i mse:f rmse:f mae:f r2:f variance:f mape:g6 improvement:f tight_pct:f mean_error:f "
               "std_error:f axis_lo:f axis_hi:f")
CHOSEN = """,
met AS (""" + _metrics_sql("allm", "param, model") + """),
pick AS (SELECT param, arg_max(model, (r2, -(CASE model WHEN 'weighted' THEN 1 WHEN 'persistence' THEN 2
                                                 WHEN 'roll7' THEN 3 ELSE 4 END))) AS chosen_model,
                max(r2) AS chosen_score FROM met GROUP BY param),
chosen AS (SELECT a.* FROM allm a JOIN pick p ON a.param = p.param AND a.model = p.chosen_model),
vr AS (SELECT *, (actual - predicted) / (predicted + 1e-10) AS ratio,
              (actual - predicted) / (predicted + 1e-10) * 100 AS pct FROM chosen),
vsum AS (SELECT param, count(*) AS "Total_Records",
                count(*) FILTER (WHERE ratio >= -0.10 AND ratio <= 0.10) AS "Records_In_Range",
                count(*) FILTER (WHERE ratio >= -0.10 AND ratio <= 0.10) / count(*) * 100 AS "Percentage_In_Range",
                avg(ratio) AS "Mean_Variance", quantile_cont(ratio, 0.5) AS "Median_Variance",
                stddev_pop(ratio) AS "Std_Variance", min(ratio) AS "Min_Variance", max(ratio) AS "Max_Variance"
         FROM vr GROUP BY param),
rl AS (SELECT param, CASE WHEN pct < -10 THEN '<-10%' WHEN pct < -5 THEN '<-5%' WHEN pct < 0 THEN '-5% to 0%'
                          WHEN pct <= 5 THEN '0% to +5%' WHEN pct <= 10 THEN '>5% to 10%' WHEN pct > 10 THEN '>10%' END
                     AS range FROM vr),
labels AS (SELECT * FROM (VALUES {labels}) t(range_order, range)),
grid AS (SELECT p.param, l.range_order, l.range FROM (SELECT DISTINCT param FROM vr) p, labels l),
rc AS (SELECT g.param, g.range_order, g.range, coalesce(c.cnt, 0) AS count
       FROM grid g LEFT JOIN (SELECT param, range, count(*) AS cnt FROM rl GROUP BY 1, 2) c
       ON g.param = c.param AND g.range = c.range)""".replace(
    "{labels}", ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(RANGE_LABELS)))

PRED = _obs() + CANDS


def q_er_prediction_errors() -> str:
    body = PRED + """,
final AS (SELECT site, param, ts AS day, model, actual, predicted, actual - predicted AS error,
                 abs(actual - predicted) AS abs_error,
                 (actual - predicted) / (abs(actual) + 1e-10) * 100 AS percent_error,
                 (actual - predicted) / (predicted + 1e-10) AS variance FROM cands)"""
    return _norm(body, "site:s param:s day:d model:s actual:f predicted:f error:f abs_error:f "
                       "percent_error:g6 variance:g6")


def q_ag01_07_metrics() -> str:
    body = PRED + ",\nfinal AS (" + _metrics_sql("cands", "param, model") + ")"
    return _norm(body, "param:s model:s " + METRIC_SPEC)


def q_ml07_fixed_blend() -> str:
    body = PRED + """,
fb AS (SELECT site, param, ts, 'blend' AS model, actual, train_mean,
              sum(CASE model WHEN 'persistence' THEN 0.6 ELSE 0.4 END * predicted) AS predicted
       FROM cands WHERE model IN ('persistence', 'climatology')
       GROUP BY site, param, ts, actual, train_mean HAVING count(*) = 2),
final AS (""" + _metrics_sql("fb", "param, model") + ")"
    return _norm(body, "param:s model:s " + METRIC_SPEC)


def q_ml08_r2_weights() -> str:
    body = PRED + ",\nfinal AS (SELECT * FROM weights)"
    return _norm(body, "param:s model:s weight:f")


def q_ml10_model_choice() -> str:
    body = PRED + CHOSEN + """,
final AS (SELECT p.param, p.chosen_model, p.chosen_score, m.n, m.mse, m.rmse, m.mae, m.r2, m.variance,
                 m.mape, m.improvement, m.tight_pct
          FROM pick p JOIN met m ON p.param = m.param AND p.chosen_model = m.model)"""
    return _norm(body, "param:s chosen_model:s chosen_score:f n:i mse:f rmse:f mae:f r2:f variance:f "
                       "mape:g6 improvement:f tight_pct:f")


VSUM_SPEC = ("Total_Records:i Records_In_Range:i Percentage_In_Range:f Mean_Variance:g6 Median_Variance:g6 "
             "Std_Variance:g6 Min_Variance:g6 Max_Variance:g6")


def q_ag08_09_variance_summary() -> str:
    return _norm(PRED + CHOSEN + ",\nfinal AS (SELECT * FROM vsum)", "param:s " + VSUM_SPEC)


def q_ag10_overall_in_range() -> str:
    body = PRED + CHOSEN + """,
final AS (SELECT sum("Total_Records") AS total_points, sum("Records_In_Range") AS points_in_range,
                 sum("Records_In_Range") / sum("Total_Records") * 100 AS overall_pct FROM vsum)"""
    return _norm(body, "total_points:i points_in_range:i overall_pct:f")


def q_ag14_15_range_breakdown() -> str:
    cols = ", ".join(f"sum(CASE WHEN param = '{p}' THEN count END) AS \"{p}\"" for p in PARAMS)
    tot = " + ".join(f'coalesce("{p}", 0)' for p in PARAMS)
    body = PRED + CHOSEN + f""",
pv AS (SELECT range_order, range, {cols} FROM rc GROUP BY 1, 2),
final AS (SELECT range_order, range, {", ".join(f'coalesce("{p}", 0) AS "{p}"' for p in PARAMS)},
                 {tot} AS "TOTAL" FROM pv)"""
    return _norm(body, "range_order:i range:s " + " ".join(f"{p}:i" for p in PARAMS) + " TOTAL:i")


def q_ag16_17_range_shares() -> str:
    body = PRED + CHOSEN + """,
per AS (SELECT range_order, range, sum(count) AS count FROM rc GROUP BY 1, 2),
tot AS (SELECT sum(count) AS total, sum(count) FILTER (WHERE range_order IN (2, 3)) AS exc,
               sum(count) FILTER (WHERE range_order IN (2, 3, 4)) AS good FROM per),
final AS (
  SELECT range_order, range, count, count / total * 100 AS share_pct FROM per, tot
  UNION ALL SELECT 10, 'excellent -5% to +5%', exc, exc / total * 100 FROM tot
  UNION ALL SELECT 11, 'good -5% to +10%', good, good / total * 100 FROM tot
  UNION ALL SELECT 12, 'outside', total - good, (total - good) / total * 100 FROM tot)"""
    return _norm(body, "range_order:i range:s count:i share_pct:f")


def q_ag18_19_param_range_share() -> str:
    body = PRED + CHOSEN + """,
final AS (SELECT param, range_order, range, count,
                 count / sum(count) OVER (PARTITION BY param) * 100 AS pct_of_param FROM rc)"""
    return _norm(body, "param:s range_order:i range:s count:i pct_of_param:f")


def q_ag20_error_histogram() -> str:
    body = PRED + CHOSEN + """,
x AS (SELECT param, actual - predicted AS x FROM chosen),
rng AS (SELECT param, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                      CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM x GROUP BY param),
j AS (SELECT x.param, x.x, r.lo, r.hi, (r.hi - r.lo) / 50 AS step,
             least(greatest(floor((x.x - r.lo) * (50 / (r.hi - r.lo))), 0), 49) AS i0
      FROM x JOIN rng r ON x.param = r.param),
j1 AS (SELECT *, CASE WHEN x < CASE WHEN i0 >= 50 THEN hi ELSE i0 * step + lo END THEN i0 - 1 ELSE i0 END AS i1 FROM j),
j2 AS (SELECT *, CASE WHEN x >= CASE WHEN i1 + 1 >= 50 THEN hi ELSE (i1 + 1) * step + lo END AND i1 <> 49
                      THEN i1 + 1 ELSE i1 END AS bin FROM j1),
cnt AS (SELECT param, bin, count(*) AS count FROM j2 GROUP BY 1, 2),
hgrid AS (SELECT param, lo, hi, unnest(range(0, 50)) AS bin FROM rng),
final AS (SELECT g.param, g.bin,
                 CASE WHEN g.bin >= 50 THEN g.hi ELSE g.bin * ((g.hi - g.lo) / 50) + g.lo END AS bin_lo,
                 CASE WHEN g.bin + 1 >= 50 THEN g.hi ELSE (g.bin + 1) * ((g.hi - g.lo) / 50) + g.lo END AS bin_hi,
                 coalesce(c.count, 0) AS count
          FROM hgrid g LEFT JOIN cnt c ON g.param = c.param AND g.bin = c.bin)"""
    return _norm(body, "param:s bin:i bin_lo:f bin_hi:f count:i")


def q_ag15_19_breakdown_by_param() -> str:
    cols = ", ".join(f"sum(count) FILTER (WHERE range_order = {i}) AS range_{i}" for i in range(6))
    body = PRED + CHOSEN + f""",
final AS (SELECT param, {cols}, sum(count) AS "TOTAL" FROM rc GROUP BY param)"""
    return _norm(body, "param:s " + " ".join(f"range_{i}:i" for i in range(6)) + " TOTAL:i")


def q_ag20_ratio_histogram() -> str:
    sql = q_ag20_error_histogram()
    sql = sql.replace("actual - predicted AS x FROM chosen", "ratio AS x FROM vr")
    body = sql[sql.index("WITH ") + 5:sql.rindex("\nSELECT ")]
    return _norm(body, "param:s bin:i bin_lo:g6 bin_hi:g6 count:i")


def q_ag23_cv_summary() -> str:
    body = _days() + CLEAN + f""",
fo AS (SELECT unnest(range(0, 5)) AS fold),
pr AS (SELECT param, ts, value AS actual,
              coalesce(lag(value, 1) OVER ({W}), CASE WHEN n > 1 THEN first_value(value) OVER ({W}) END) AS predicted
       FROM clean),
te AS (SELECT p.*, fo.fold FROM pr p JOIN days d ON p.ts = d.ts, fo
       WHERE d.pos >= d.nd - (5 - fo.fold) * (d.nd // 6)
         AND d.pos < d.nd - (5 - fo.fold) * (d.nd // 6) + (d.nd // 6) AND p.predicted IS NOT NULL),
sc AS (SELECT param, fold,
              CASE WHEN var_pop(actual) = 0 THEN
                     CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
                   ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END AS r2
       FROM te GROUP BY 1, 2),
final AS (SELECT param, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std FROM sc GROUP BY param)"""
    return _norm(body, "param:s cv_mean:f cv_std:f")


def q_ag11_13_quality_summary() -> str:
    body = PRED + CHOSEN + """,
m1 AS (""" + _metrics_sql("chosen", "param") + """),
agg AS (SELECT count(*) AS n_params, avg(r2) AS avg_r2, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae,
               avg(variance) AS avg_variance, avg(mape) AS avg_mape, avg(improvement) AS avg_improvement,
               avg(tight_pct) AS avg_tight_pct, count(*) FILTER (WHERE r2 > 0.7) AS n_good,
               count(*) FILTER (WHERE r2 > 0.5 AND r2 <= 0.7) AS n_acceptable,
               count(*) FILTER (WHERE r2 <= 0.5) AS n_poor FROM m1),
final AS (SELECT *, CASE WHEN avg_r2 > 0.6 THEN 'good' WHEN avg_r2 > 0.4 THEN 'moderate' ELSE 'insufficient' END
                 AS quality, avg_r2 > 0.4 AS forecast_allowed FROM agg)"""
    return _norm(body, "n_params:i avg_r2:f avg_rmse:f avg_mae:f avg_variance:f avg_mape:g6 avg_improvement:f "
                       "avg_tight_pct:f n_good:i n_acceptable:i n_poor:i quality:s forecast_allowed:b")


def q_tk1_best_worst() -> str:
    order = "CASE param " + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(PARAMS)) + " END"
    body = PRED + CHOSEN + f""",
o AS (SELECT *, {order} AS ord FROM vsum),
final AS (SELECT arg_max(param, ("Percentage_In_Range", -ord)) AS best_param, max("Percentage_In_Range") AS best_value,
                 arg_min(param, ("Percentage_In_Range", ord)) AS worst_param, min("Percentage_In_Range") AS worst_value
          FROM o)"""
    return _norm(body, "best_param:s best_value:f worst_param:s worst_value:f")


def q_gr_grade_bands() -> str:
    body = PRED + CHOSEN + """,
m1 AS (""" + _metrics_sql("chosen", "param") + """),
final AS (SELECT m.param,
   CASE WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.5 THEN 'acceptable' ELSE 'poor' END AS r2_band_t2,
   CASE WHEN r2 > 0.95 THEN 'excellent' WHEN r2 > 0.9 THEN 'very good' WHEN r2 > 0.7 THEN 'good'
        ELSE 'needs improvement' END AS r2_band_t3,
   CASE WHEN tight_pct >= 70 THEN '>=70' WHEN tight_pct >= 60 THEN '>=60' ELSE 'below' END AS tight_band_t2,
   CASE WHEN tight_pct >= 90 THEN '>=90' WHEN tight_pct >= 80 THEN '>=80' WHEN tight_pct >= 70 THEN '>=70'
        ELSE 'below' END AS tight_band_t3,
   CASE WHEN "Percentage_In_Range" >= 90 THEN '>=90' WHEN "Percentage_In_Range" >= 70 THEN '>=70'
        ELSE 'below' END AS in_range_band,
   CASE WHEN abs("Mean_Variance") < 0.05 THEN 'low' WHEN abs("Mean_Variance") < 0.15 THEN 'moderate'
        ELSE 'high' END AS bias_band,
   CASE WHEN "Std_Variance" < 0.2 THEN 'consistent' WHEN "Std_Variance" < 0.5 THEN 'moderate'
        ELSE 'high' END AS spread_band
  FROM m1 m JOIN vsum v ON m.param = v.param)"""
    return _norm(body, "param:s r2_band_t2:s r2_band_t3:s tight_band_t2:s tight_band_t3:s in_range_band:s "
                       "bias_band:s spread_band:s")


def _days() -> str:
    return _obs() + """,
days AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS nd
         FROM (SELECT DISTINCT ts FROM wide))"""


def q_ml14_time_folds() -> str:
    body = _days() + """,
fo AS (SELECT unnest(range(0, 5)) AS fold),
final AS (SELECT w.site, w.ts AS day, CAST(fo.fold AS INTEGER) AS fold,
                 CASE WHEN d.pos < d.nd - (5 - fo.fold) * (d.nd // 6) THEN 'train' ELSE 'test' END AS role
          FROM wide w JOIN days d ON w.ts = d.ts, fo
          WHERE d.pos < d.nd - (5 - fo.fold) * (d.nd // 6) + (d.nd // 6))"""
    return _norm(body, "site:s day:d fold:i role:s")


def q_ml12_contiguous_folds() -> str:
    body = _days() + """,
final AS (SELECT w.site, w.ts AS day,
   CASE WHEN d.pos < (d.nd % 5) * (d.nd // 5 + 1) THEN d.pos // (d.nd // 5 + 1)
        ELSE (d.nd % 5) + (d.pos - (d.nd % 5) * (d.nd // 5 + 1)) // (d.nd // 5) END AS fold
   FROM wide w JOIN days d ON w.ts = d.ts)"""
    return _norm(body, "site:s day:d fold:i")


def _scale(kind: str) -> str:
    if kind == "standard":
        fit = ("avg(value) AS centre, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale")
    else:
        fit = ("quantile_cont(value, 0.5) AS centre, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) = 0 "
               "THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale")
    body = _obs() + CLEAN + f""",
fit AS (SELECT param, {fit} FROM clean WHERE ts < DATE '2000-01-01' GROUP BY param),
final AS (SELECT c.param, c.site, c.ts AS day, (c.value - f.centre) / f.scale AS scaled
          FROM clean c JOIN fit f ON c.param = f.param)"""
    return _norm(body, "param:s site:s day:d scaled:f")


def q_ml01_standard_scale() -> str:
    return _scale("standard")


def q_ml02_robust_scale() -> str:
    return _scale("robust")


def q_ml13_ridge_stack() -> str:
    """Ridge over three inputs in closed form (Cramer's rule on the centred normal equations)."""
    body = PRED + """,
mu AS (SELECT param, avg(persistence) AS mp, avg(roll7) AS mr, avg(climatology) AS mc, avg(actual) AS my
       FROM t GROUP BY param),
xs AS (SELECT t.param, persistence - mp AS a, roll7 - mr AS b, climatology - mc AS c, actual - my AS y
       FROM t JOIN mu ON t.param = mu.param),
g AS (SELECT param, sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(c * c) + 1 AS cc, sum(a * b) AS ab,
             sum(a * c) AS ac, sum(b * c) AS bc, sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS yc
      FROM xs GROUP BY param),
s AS (SELECT param, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
             ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc) AS d1,
             aa * (yb * cc - bc * yc) - ay * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac) AS d2,
             aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ay * (ab * bc - bb * ac) AS d3 FROM g),
final AS (SELECT s.param, my - (mp * d1 + mr * d2 + mc * d3) / det AS intercept, d1 / det AS w_persistence,
                 d2 / det AS w_roll7, d3 / det AS w_climatology
          FROM s JOIN mu ON s.param = mu.param)"""
    return _norm(body, "param:s intercept:f w_persistence:f w_roll7:f w_climatology:f")


FORECAST = PRED + CHOSEN + """,
last AS (SELECT site, param, arg_max(value, ts) AS last_value FROM clean GROUP BY 1, 2),
tr AS (SELECT * FROM clean WHERE ts < DATE '2000-01-01'),
tm2 AS (SELECT site, param, avg(value) AS train_mean FROM tr GROUP BY 1, 2),
mm2 AS (SELECT site, param, month(ts) AS m, avg(value) AS clim FROM tr GROUP BY 1, 2, 3),
nxt AS (SELECT site, year(max(ts)) + 1 AS fy FROM clean GROUP BY site),
cal AS (SELECT site, CAST(unnest(generate_series(make_date(fy, 1, 1), make_date(fy, 12, 31),
               INTERVAL 1 DAY)) AS DATE) AS ts FROM nxt),
ww AS (SELECT param, max(CASE WHEN model = 'persistence' THEN weight END) AS w_p,
              max(CASE WHEN model = 'roll7' THEN weight END) AS w_r,
              max(CASE WHEN model = 'climatology' THEN weight END) AS w_c FROM weights GROUP BY param),
d AS (SELECT c.site, l.param, c.ts, l.last_value, coalesce(mm2.clim, tm2.train_mean) AS clim
      FROM cal c JOIN last l ON c.site = l.site
      LEFT JOIN tm2 ON l.site = tm2.site AND l.param = tm2.param
      LEFT JOIN mm2 ON l.site = mm2.site AND l.param = mm2.param AND month(c.ts) = mm2.m),
fc AS (SELECT d.site, d.param, d.ts AS day, p.chosen_model,
   CASE p.chosen_model WHEN 'weighted' THEN ww.w_p * d.last_value + ww.w_r * d.last_value + ww.w_c * d.clim
        WHEN 'persistence' THEN d.last_value WHEN 'roll7' THEN d.last_value ELSE d.clim END AS predicted
   FROM d JOIN pick p ON d.param = p.param JOIN ww ON d.param = ww.param)"""


def q_ml17_forecast_baseline() -> str:
    body = FORECAST + ",\nfinal AS (SELECT * FROM fc)"
    return _norm(body, "site:s param:s day:d chosen_model:s predicted:f")


def q_ml15_cv_stack() -> str:
    """Per expanding fold the ridge in closed form on the rows before it, scored on its own rows."""
    body = PRED + """,
d2 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS nd FROM (SELECT DISTINCT ts FROM t)),
fo AS (SELECT unnest(range(0, 5)) AS fold),
z AS (SELECT t.*, d2.pos, d2.nd, fo.fold, d2.nd - (5 - fo.fold) * (d2.nd // 6) AS cut
      FROM t JOIN d2 ON t.ts = d2.ts, fo
      WHERE persistence IS NOT NULL AND roll7 IS NOT NULL AND climatology IS NOT NULL AND actual IS NOT NULL),
tr2 AS (SELECT * FROM z WHERE pos < cut),
te2 AS (SELECT * FROM z WHERE pos >= cut AND pos < cut + nd // 6),
mu AS (SELECT param, fold, avg(persistence) AS mp, avg(roll7) AS mr, avg(climatology) AS mc, avg(actual) AS my
       FROM tr2 GROUP BY 1, 2),
xs AS (SELECT param, fold, persistence - mp AS a, roll7 - mr AS b, climatology - mc AS c, actual - my AS y
       FROM tr2 JOIN mu USING (param, fold)),
g AS (SELECT param, fold, sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(c * c) + 1 AS cc, sum(a * b) AS ab,
             sum(a * c) AS ac, sum(b * c) AS bc, sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS yc
      FROM xs GROUP BY 1, 2),
s AS (SELECT param, fold, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
             ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc) AS n1,
             aa * (yb * cc - bc * yc) - ay * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac) AS n2,
             aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ay * (ab * bc - bb * ac) AS n3 FROM g),
w AS (SELECT s.param, s.fold, n1 / det AS w1, n2 / det AS w2, n3 / det AS w3,
             my - (mp * n1 + mr * n2 + mc * n3) / det AS w0 FROM s JOIN mu USING (param, fold)),
pr AS (SELECT param, fold, actual, w0 + w1 * persistence + w2 * roll7 + w3 * climatology AS predicted
       FROM te2 JOIN w USING (param, fold)),
sc AS (SELECT param, fold, CASE WHEN var_pop(actual) = 0 THEN 0.0
              ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END AS r2
       FROM pr GROUP BY 1, 2),
final AS (SELECT param, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std FROM sc GROUP BY param)"""
    return _norm(body, "param:s cv_mean:f cv_std:f")


def q_ml03_boosted_tree() -> str:
    """Split gains of the first two levels from (node, feature, bin) sums."""
    order = "CASE f " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PARAMS)) + " END"
    t = lambda g: f"(sign({g}) * greatest(abs({g}) - 0.05, 0))"
    gain = (f"0.5 * ({t('gl')} * {t('gl')} / (hl + 1) + {t('(gt - gl)')} * {t('(gt - gl)')} / (ht - hl + 1) "
            f"- {t('gt')} * {t('gt')} / (ht + 1))")

    def level(rows: str, k: int) -> str:
        return f"""
s{k} AS (SELECT t, node, f, code, sum(g) AS g, count(*) AS h FROM {rows} JOIN codes USING (site, ts) GROUP BY 1, 2, 3, 4),
c{k} AS (SELECT t, node, f, code, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER v AS gt, sum(h) OVER v AS ht
       FROM s{k} WINDOW u AS (PARTITION BY t, node, f ORDER BY code), v AS (PARTITION BY t, node, f)),
b{k} AS (SELECT *, {gain} AS gain FROM c{k} WHERE hl >= 1 AND ht - hl >= 1 AND code < 15),
p{k} AS (SELECT t, node, f, code, gain FROM b{k} WHERE gain > 0
       QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY gain DESC, {order}, code) = 1),
n{k} AS (SELECT t, node, sum(g) AS g, count(*) AS h FROM {rows} GROUP BY 1, 2)"""

    body = _obs() + CLEAN + f""",
pv AS (SELECT site, ts, param, value, coalesce(lag(value, 1) OVER ({W}), CASE WHEN n > 1 THEN first_value(value) OVER ({W}) END)
              AS prev FROM clean),
lims AS (SELECT param, min(prev) AS lo, max(prev) AS hi FROM pv GROUP BY 1),
codes AS (SELECT site, ts, param AS f, CASE WHEN hi > lo THEN list_sum(list_transform(range(1, 16),
            lambda i: CASE WHEN prev >= lo + (hi - lo) * i / 16 THEN 1 ELSE 0 END)) ELSE 0 END AS code
          FROM pv JOIN lims USING (param)),
base AS (SELECT param, avg(value) AS b FROM clean GROUP BY 1),
r0 AS (SELECT site, ts, param AS t, 0 AS node, b - value AS g FROM clean JOIN base USING (param)),{level("r0", 0)},
r1 AS (SELECT r0.site, r0.ts, r0.t, CASE WHEN codes.code <= p0.code THEN 1 ELSE 2 END AS node, g
       FROM r0 JOIN p0 ON r0.t = p0.t JOIN codes ON codes.site = r0.site AND codes.ts = r0.ts AND codes.f = p0.f),{level("r1", 1)},
every_ AS (SELECT n0.t, n0.node, n0.g, n0.h, f, code, gain FROM n0 LEFT JOIN p0 ON n0.t = p0.t AND n0.node = p0.node
           UNION ALL SELECT n1.t, n1.node, n1.g, n1.h, f, code, gain FROM n1 LEFT JOIN p1 ON n1.t = p1.t AND n1.node = p1.node),
final AS (SELECT t AS param, node, f AS feature, code AS cut, coalesce(gain, 0) AS gain, h AS n, -{t("g")} / (h + 1) AS leaf FROM every_)"""
    return _norm(body, "param:s node:i feature:s cut:i gain:g6 n:i leaf:g6")


def q_ml09_ml11_choice_orders() -> str:
    def first(order: dict[str, str]) -> str:
        rank = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(order)) + " ELSE 99 END"
        name = "CASE model " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in order.items()) + " END"
        known = ", ".join(f"'{m}'" for m in order)
        return (f"SELECT param, {name} AS pick, s FROM (SELECT *, round(r2 * 10) / 10 AS s FROM met WHERE model IN ({known})) "
                f"QUALIFY row_number() OVER (PARTITION BY param ORDER BY s DESC, {rank}) = 1")
    body = PRED + CHOSEN + f""",
t1 AS ({first({"weighted": "blend", "persistence": "gbt_a", "roll7": "rf"})}),
t3 AS ({first({"weighted": "stack", "persistence": "gbt_a", "roll7": "rf", "climatology": "extra"})}),
final AS (SELECT t1.param, t1.pick AS tier1, t3.pick AS tier3, t3.s AS chosen_score FROM t1 JOIN t3 USING (param))"""
    return _norm(body, "param:s tier1:s tier3:s chosen_score:f")



def registry() -> dict[str, str]:
    return {name[2:]: fn() for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
