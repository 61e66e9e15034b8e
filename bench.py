"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query is
planned, run to its last row and its rows discarded; the first run of a query counts.
"""

from __future__ import annotations

import json
import os
import time

from panelmill.plans.catalog import QUERIES
from panelmill.session import local_session

HEADLINE = (
    "label_counts", "label_rows", "lifetime_rows", "lags_and_deltas", "full_history_panel", "mixed_feature_panel",
    "fixed_window_flag_panel", "repaired_transition_panel", "sums_and_streaks_panel", "ranked_history_panel",
    "deflated_panel", "period_rank_functions", "period_medians", "flag_lift_table", "univariate_auc_per_period",
    "concept_drift_screen", "cumulative_gain", "rank_ensemble", "scenario_regret", "public_private_draws",
    "bootstrap_gain_difference", "ledger_rollup", "model_scores_by_seed",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name].job(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
