"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "a4_reconcile",
    "a5_loss_trend",
    "j11_daily_balance",
    "a7_peer_median_daily",
    "w1_rolling_14d_avg",
    "w2_peer_group_median",
    "w5_olap_customer_features",
    "w6_trailing_sequence",
    "a21_customer_stats",
    "a25_transformer_features",
    "f8_customer_components",
    "w8_attribution_share",
    "f11_build_explanations",
    "a9_kpi_summary",
    "a10_region_hotspots",
    "a11_cell_hotspots",
    "l1_ranked_customers",
    "l2_inspection_queue",
    "a18_fold_case_events",
    "a19_mission_rollup",
    "w9_average_precision",
    "w11_case_rank",
    "y4_mse_to_anomaly",
    "y7_expand_annual_profile",
    "s7_read_utilization_payload",
    "s11_upsert",
    "t2_stream_hourly_volume",
    "m3_ntl_classifier",
    "m4_isolation_forest",
    "m8_predict_frame",
)


def main() -> None:
    from wattlens.session import build_session, owned_stages, ship_package

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "5g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    ship_package(spark)
    spark.sparkContext.setLogLevel("ERROR")
    from wattlens.plans.catalog import QUERIES

    spark.read.parquet(f"{folder}/events.parquet").count()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        with owned_stages(spark):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{seconds[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
