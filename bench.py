"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tiepoints.plans.queries import QUERIES
from tiepoints.session import local_session

HEADLINE = [
    "chip_consensus",
    "chip_consensus_fitted",
    "ransac_affine",
    "match_stats",
    "pol_summary",
    "best_config",
    "window_clean",
    "match_record",
    "record_files_roundtrip",
    "file_id_parse",
    "pol_reference_join",
    "min_matches",
    "pixel_to_map",
    "nearest_gcp",
    "mutual_nn",
    "smnn_ratio",
    "dual_softmax",
    "local_consistency",
    "top_keypoints",
    "chip_gate",
    "chip_quantize",
    "matcher_udf",
    "registry_resolve",
    "sweep_grid",
    "run_summary",
    "incremental_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("chip_consensus")  # start-up is not part of any query
    seconds = {name: run(name) for name in sys.argv[1:] or HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
            }
        )
    )


if __name__ == "__main__":
    main()
