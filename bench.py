"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_weekly_bars", "w2_moving_averages", "w9_rsi", "w10_adx", "w11_macd", "w12_stochastic", "w15_obv_ad_lines", "w21_rolling_profile",
    "w35_relative_strength", "c5_price_units", "c6_canonical_sessions", "c8_scale_break_repair", "j1_asof_per_symbol", "j1_asof_positioning",
    "j15_pair_correlations", "a3_volume_profile", "g1_cot_monitor", "g2_volume_price_detector", "g4_market_regime", "g5_quant_money_flow",
    "g7_volume_intelligence", "a11_headline_sentiment", "g21_headline_events", "k3_volume_spread_flags", "k7_wyckoff_signal", "p1_order_blocks",
    "p2_fair_value_gaps", "p4_structure_breaks", "p7_structure_score", "p9_retest_entries", "e4_wave_confidence", "x4_institutional_score",
    "x5_entry_grades", "w28_ranks", "r1_value_at_risk", "r10_entry_outcomes", "r12_curve_metrics", "st1_hourly_bars",
]

#: Runs as well where BENCH_WIDE is set; not in the headline, so that its sum stays comparable.
WIDE = ["s2_merged_in_place", "st6_structure_state", "st9_zone_alerts", "m6_walk_forward_refits", "m2_panel_forecasts", "m4_anomaly_forest", "p13_smart_entries", "p15_scan_entry_candidate",
        "p16_entry_radar", "x_universe_scan"]


def main() -> None:
    from tickloom.plans import load
    from tickloom.session import local_session
    from tickloom.sources import driver_tables as dt

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    queries, _ = load()
    times: dict[str, float] = {}
    start = time.time()
    for name in ("bars_daily", "benchmark_daily", "bars_hourly", "positioning"):
        t = time.time()
        dt.derived(spark, sf_dir, name)
        times[f"build_{name}"] = round(time.time() - t, 3)
    for name in HEADLINE + (WIDE if os.environ.get("BENCH_WIDE") else []):
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(time.time() - start, 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
