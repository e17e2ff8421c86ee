"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {...}, "sf": ...}.  Each query is forced end to end with the
no-op sink (every row computed, nothing shipped to the driver).  The
first query builds the master from the raw tables and writes the Parquet
checkpoint; later queries read it, as the pipeline does.
A query that fails is named under "failed"; times go to stderr as they come.
Set BENCH_MODELS=0 to skip the forest comparison (the slowest step).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

REPORT_QUERIES = [
    "oos_share_by_operation", "missing_profile", "numeric_summary", "cut_buckets", "box_stats",
    "kde_by_group", "heat_table", "unpivot_long", "violin_stats", "corr_pairwise", "loglog_fit", "bin2d",
    "ntile_decile", "exact_quantiles", "topk_ties", "histogram_log10",
]
MODEL_QUERIES = ["strat_split", "state_tier", "auc_midrank", "roc_points", "confusion_kappa", "kruskal_wallis"]
SEGMENT_QUERIES = ["cluster_matrix", "zscore", "kmeans_labels", "segment_profile", "elbow_wss", "silhouette_k"]
FOREST_QUERIES = ["ablation", "model_comparison", "perm_importance", "oob_curve"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with_models = os.environ.get("BENCH_MODELS", "1") != "0"
    from carrisk.plans import master as M
    from carrisk.plans.registry import QUERIES, load_all
    from carrisk.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    load_all()
    times: dict[str, float] = {}

    t0 = time.perf_counter()
    M.master_for(spark, sf_dir)
    times["master_build"] = round(time.perf_counter() - t0, 3)

    names = REPORT_QUERIES + MODEL_QUERIES + SEGMENT_QUERIES + (FOREST_QUERIES if with_models else [])
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # recorded; the other queries still run
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"
        else:
            times[name] = round(time.perf_counter() - t0, 3)
        print(name, times.get(name, "failed"), file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "failed": failed}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
