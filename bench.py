"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from antipode.plans import QUERIES  # noqa: E402
from antipode.session import local_session  # noqa: E402

HEADLINE = (
    "differential_summary", "best_per_type_and_class", "enumerate_pairs", "relationship_counts",
    "by_range_class", "spearman", "quartile_contrast", "binary_metrics", "log_fit", "value_summary",
    "property_class", "compare_profiles", "top_target", "cosine_topk", "nearest_of_all", "novelty",
    "canonical_order", "spectrum", "differential_score", "activity_index", "fit_per_group", "formula_tokens",
    "incremental_enrich",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "antipode-bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session outside the timings
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
