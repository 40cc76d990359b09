"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from curate.session import build_session
from curate.workload.catalog import QUERIES

HEADLINE = (
    "core_metrics confusion_matrix evaluate_systems ensemble_with_priors ensemble_evaluation roc_points "
    "macro_pr_curve pairwise_signed_rank read_corpus stratified_split filter_candidates best_similarity "
    "prompt_plan perturbed_oversample augment validation_loss early_stop curve_order scenario_jobs "
    "train_classifiers chosen_cluster_count cluster_texts augment_one_class"
).split()


def run(names: list[str]) -> dict[str, float]:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    return times


if __name__ == "__main__":
    run(sys.argv[1:] or HEADLINE)
