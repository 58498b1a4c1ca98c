"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftline.plans import catalog
from weftline.session import local_session

HEADLINE = (
    "pair_summary", "corr_full", "corr_wide_embeddings", "corr_directed", "corr_partial3", "te_full", "ordinal_full", "dcor_full",
    "mutinf_full", "ah_full", "coherence", "granger_full", "clean_chain", "outlier_robust_mask", "norm_rank_avg", "scan_cube",
    "lag_opt", "fft_peaks", "adf", "qc_table", "fdr_bh", "pca", "graph_clustering", "neighbor_pairs_26",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("weftline-bench", cores, int(cores) if cores.isdigit() else 8)
    queries, _ = catalog.load()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in only:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
