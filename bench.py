"""Times the headline queries; prints one JSON line.

Shared stages (split, encoded rows, fitted models) are timed by the query that first
needs them, in the order below. A query that fails, or takes longer than its limit, is listed
with the reason and has no figure; the others keep theirs.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from flowlucid.config import build_session
from flowlucid.plans.queries import registered

# The forests here learn a label that follows from the features but for one row in a hundred. On the
# fixture's own label, which the features say nothing about, trees memorise all rows and a
# forest of 100 does not fit in this time; see README.
HEADLINE = [
    "flow_profile", "count_by_label", "weekly_counts", "weekly_sheet", "split_stratified", "undersample", "sample_rows",
    "standardize", "class_report", "dt_binary", "lr_binary", "lr_tactic", "gnb_binary",
    "kernel_shap_lr", "kernel_shap_nb", "kernel_shap_model_total", "lime_discretizer", "pdp_nb", "lime_moments",
    "rf_signal", "tree_shap_rf_signal", "pdp_signal", "lime_signal", "tree_shap_interaction_signal",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    limit = float(os.environ.get("BENCH_LIMIT", "240"))
    whole = float(os.environ.get("BENCH_SECONDS", "1500"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("flowlucid-bench", cpus=cpus, memory=os.environ.get("BENCH_MEMORY", "4g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, seconds, missing, begun = registered(), {}, {}, time.perf_counter()
    for name in names:
        if time.perf_counter() - begun > whole:
            missing[name] = "no time left"
            continue
        start, over = time.perf_counter(), threading.Event()

        def watch(over: threading.Event = over) -> None:
            if not over.wait(limit):
                while not over.wait(2):
                    spark.sparkContext.cancelAllJobs()

        threading.Thread(target=watch, daemon=True).start()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        except Exception as error:  # the others' figures stay
            late = time.perf_counter() - start > limit
            missing[name] = f"over {limit:.0f} s" if late else f"{type(error).__name__}: {str(error).splitlines()[0][:120]}"
            print(f"{name}: {missing[name]}", file=sys.stderr, flush=True)
        finally:
            over.set()
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "missing": missing, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    try:
        spark.stop()
    except Exception as error:
        print(f"stop: {type(error).__name__}", file=sys.stderr)


if __name__ == "__main__":
    main()
