"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local
cores (default 8). Every query is evaluated in full into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from intertie.queries import load  # noqa: E402
from intertie.session import build_session  # noqa: E402

HEADLINE = [
    "bucket_avg_then_sum",
    "quarterly_residue",
    "final_settlement_summary",
    "reconcile_payouts",
    "certify_quarters",
    "latest_version",
    "product_as_of",
    "calibration_argmin",
    "apply_calibration",
    "correlation_spearman",
    "tranche_backtest",
    "product_marks",
    "trade_candidates",
    "price_signals",
    "forecast_overlay",
    "cumulative_revenue",
    "fcas_priority_revenue_weighted",
    "wind_annual",
    "nearest_factor",
    "keyword_search",
    "vector_search",
    "degree_counts",
    "read_residue_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().queries
    timings: dict[str, float] = {}
    # The first job pays for starting the engine; it is not part of any query.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    for name in HEADLINE:
        if name not in queries:
            continue
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
