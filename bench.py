"""Headline queries at one scale; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_REPEAT (runs per query, best kept).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortloom.plans.queries import REGISTRY
from cohortloom.session import local_session

# One query per stage of the published pipelines.
HEADLINE = [
    "qc_cohort",
    "encoding_design",
    "ridge_path",
    "noise_ceiling",
    "combat",
    "pca_by_subject",
    "align_sign",
    "group_axis",
    "group_glm_fdr",
    "rollup_masked",
    "participation_ratio_cov",
    "spin_p",
    "enet_cv",
    "sharp_test",
    "deviation",
    "path_fit",
    "interaction_anova",
    "silhouette",
    "spearman",
    "bh_adjust",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").mapInPandas(lambda it: it, "r_regionkey int, r_name string").count()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            start = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
