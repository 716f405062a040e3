"""Headline queries, one JSON line: BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES select the run."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "report", "fine_threshold_sweep", "feature_auc", "paired_bootstrap", "stratified_cap", "run_confusion", "region_report", "cell_fractions",
    "block_mean", "box_mean", "paper_tone", "gaussian", "gradient", "components4", "post_process", "component_ranks", "bilinear", "cosine_map",
    "exemplar_cosines", "exemplar_lda", "similarity_rank", "zero_shot", "compete", "spectra", "correlation", "blob_maps", "manifest_violations",
    "correlation_bundle", "rotation_bundle", "region_descriptors", "evidence_row",
)


def main() -> None:
    from regionmatch.plans import registry
    from regionmatch.session import build_session, drop_written

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    parts = int(cpus) if cpus.isdigit() else 8
    spark = build_session(f"local[{cpus}]", parts)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    drop_written(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
