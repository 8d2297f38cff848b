"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (data folder) and BENCH_CPUS (local cores) come from the environment.
Every query but the long ones runs once to warm up and is then timed; the whole result is computed
through the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from tradewake.plans import run
from tradewake.session import build_session

HEADLINE = (
    "label_won", "pit_features", "pit_ratios", "feature_table", "clean_trades", "market_avg_so_far", "window_count_asis",
    "window_count_trailing", "trades_per_user_market", "time_since_last", "user_profile", "user_profile_exact_having",
    "user_features_asof", "market_summary", "describe_features", "segment_profile", "correlation_matrix", "price_histogram",
    "confusion_metrics", "classification_report", "auc_global", "auc_by_bucket", "expected_return", "bucket_summary",
    "sample_per_market", "sample_diverse_wallets", "hash_sample_n", "stratified_folds", "paged_eligible_trades",
    "split_by_bucket", "insert_or_ignore", "join_inner_three", "score_live", "segment_users", "stream_ingest_dedupe",
)
# Jobs that train or search for long; they run once, without a warm-up.
LONG = ("knn_distance", "feature_importance", "model_gbt_segment", "backtest", "stream_score")


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE + LONG
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        if name not in LONG:
            timed(spark, name, sf_dir)
        seconds[name] = round(timed(spark, name, sf_dir), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
