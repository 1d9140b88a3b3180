"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tapeloom.plans import all_queries
from tapeloom.session import local_session

HEADLINE = [
    "flagship_rank_ic", "a00_intraday_all", "a26_daily_bar", "a27_roll_count", "x11_base_price_scaling", "a34_unbroken_spans",
    "w04_std", "w08_rank", "w13_corr", "f01_kbar", "f03_rolling_close", "f14_valuation", "f17_industry_relative",
    "a37_factor_health", "a40_longest_null_run", "a43_daily_rank_ic", "a45_model_summary", "a50_seed_metrics",
    "x01_robust_zscore", "x04_day_zscore", "x06_day_rank_label", "x19_lookback_tensor", "j13_universe_membership", "j14_day_over_day",
    "t02_top_n_per_day", "t07_seed_intersection", "d02_mean_daily_correlation", "d13_final_advice",
    "b02_top_k_book", "b18_book_grid", "b20_pareto_front", "b22_run_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        all_queries.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
