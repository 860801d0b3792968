"""Time the headline queries on the given tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from trustlake.catalog import QUERIES
from trustlake.session import local_session

HEADLINE = (
    "assurance_verdicts", "noisy_or", "contributor_risk", "ks_two_sample", "dimension_statistics", "mmd_rbf", "covariate_shift", "semantic_shift",
    "subpopulation_shift", "knn_join", "label_disagreement", "confusion_rates", "outlier_scores", "exact_duplicates", "hamming_join",
    "byte_features", "edge_residual", "quality_scalars", "sequence_state", "nonce_replay", "verify_records", "verify_chain", "layer_stats",
    "classification_distance", "iou_pairs", "detection_signature", "mad_outlier", "table_digest", "reconcile_store", "lineage",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    QUERIES["finding_risk"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM and file system warm-up
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
