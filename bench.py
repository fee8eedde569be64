"""Bench: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to completion through the ``noop`` sink (the whole plan executes,
nothing is collected).  ``value`` is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seriescast.config import PARAMS  # noqa: E402
from seriescast.plans import catalog  # noqa: E402
from seriescast.plans.features import build_matrix, long_features  # noqa: E402
from seriescast.plans.tiers import TIER1, TIER3  # noqa: E402
from seriescast.session import build_session  # noqa: E402
from seriescast.sources.fixtures import observations_long, split_col  # noqa: E402
from seriescast.operators import rolling as R  # noqa: E402
from seriescast.operators.fill import clean  # noqa: E402
from seriescast.operators.series import Series  # noqa: E402


def _obs(spark, sf):
    obs = observations_long(spark, sf, "supp").withColumn("split", split_col("ts"))
    return clean(obs, Series(keys=("site", "split", "param"))).drop("rn", "n", "_tb")


def tier1_matrix(spark, sf):
    """Tier-1 feature matrix (59 columns) over every site, pivot included."""
    return build_matrix(_obs(spark, sf), TIER1, PARAMS)[0]


def tier3_long(spark, sf):
    """All 65 per-parameter tier-3 features, long form (before the 699-column pivot)."""
    return long_features(_obs(spark, sf), TIER3)


def tier3_matrix(spark, sf):
    """Tier-3 feature matrix (699 columns) over every site: long features, struct pivot, physics."""
    return build_matrix(_obs(spark, sf), TIER3, PARAMS)[0]


def rolling_all(spark, sf):
    """Mean, std, min and max over every window in one pass."""
    return catalog._features(spark, sf, R.rolling_stats("value", catalog.WINDOWS, ("mean", "std", "min", "max"), "v"), 90)


def rolling_moments(spark, sf):
    """Skewness and kurtosis over every window in one pass."""
    return catalog._features(spark, sf, R.moment_stages("value", catalog.WINDOWS, prefix="v")[0], 90)


HEADLINE = {
    "clean_interpolate": catalog.q_wn14_interpolate,
    "rolling_mean_std_minmax": rolling_all,
    "rolling_skew_kurt": rolling_moments,
    "lags_365": catalog.q_wn07_lags,
    "pct_change_sweep": catalog.q_wn10_pct_change,
    "ewm_block_scan": catalog.q_wn12_13_ewm,
    "seasonal_means": catalog.q_ag24_wn19_seasonal,
    "physics": catalog.q_ph_features,
    "metrics_choice": catalog.q_ml10_model_choice,
    "variance_summary": catalog.q_ag08_09_variance_summary,
    "range_breakdown": catalog.q_ag14_15_range_breakdown,
    "forecast_baseline": catalog.q_ml17_forecast_baseline,
    "tier1_feature_matrix": tier1_matrix,
    "tier3_long_features": tier3_long,
    "tier3_feature_matrix": tier3_matrix,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(cpus=cpus, app="seriescast-bench", shuffle_partitions=max(8, 2 * int(cpus)))
    times: dict[str, float] = {}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    def report() -> None:
        print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                          "queries": times, "sf": sf, "cpus": cpus}), flush=True)

    def stopped(*_) -> None:    # a run that is ended early still says what it measured
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, stopped)
    for name, fn in HEADLINE.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    report()
    spark.stop()


if __name__ == "__main__":
    main()
