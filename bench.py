"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables and BENCH_CPUS the local threads. One warm-up query starts
the JVM; each query is then timed from building its plan to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnstate.plans.queries import QUERIES
from turnstate.session import build_session

HEADLINE = [
    "turns_from_chat", "rule_states_on_documents", "delta_profile", "event_deltas", "event_delta_profile",
    "contract_violations", "document_contract", "observer_prompt", "response_normalise", "response_first_valid",
    "response_objects", "turn_comparison", "disagreement_summary", "disagreement_breakdown", "matrix_vs_baseline",
    "token_profile", "nb_train", "nb_score", "fewshot_round_robin", "quality_gate_reasons", "template_generate",
    "generation_pending", "split_assign", "upsert_latest", "runs_by_scenario", "runs_topk", "retry_ids",
    "resume_redo", "run_progress", "extraction_outcome",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "turnstate-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            # A few megabytes should still use every local thread.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.dataFrameQueryContext.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["turns_from_chat"](spark, sf).write.format("noop").mode("overwrite").save()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
