"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads).
Every query runs once in full (rows are aggregated to nothing by a no-op
sink); one small untimed run before them starts the JVM and its code cache.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from riskpanel.plans.catalog import QUERIES
from riskpanel.session import build_session

HEADLINES = (
    "a06_reject_summary",
    "a11_load_summary",
    "b02_unpivot_periods",
    "c22_quality_suite",
    "d07_behaviour_flags",
    "e11_signal_table",
    "e11_signal_table_wide",
    "f08_signal_summary",
    "f09_band_summary",
    "g03_integrity",
    "h02_rank_split",
    "h07_exact_median_all",
    "h16_fit_three",
    "i01_roc_auc",
    "i09_segments",
    "i11_prediction_checks",
    "j07_lineage_paths",
    "j08_reachable",
    "k06_gate_rollup",
    "k09_compare_tables",
    "r07_reconciliation_evidence",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "riskpanel-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["f09_band_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in HEADLINES:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
