"""Time the headline queries: full write to the `noop` sink, median of the runs
after one warm-up.  Prints one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_MEMORY.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assetry.plans.queries import QUERIES  # noqa: E402
from assetry.session import local_session  # noqa: E402

HEADLINE = (
    "parse_filename",
    "update",
    "read_files",
    "read_assets",
    "asset_metadata",
    "rule_dense_coordinates",
    "graph_nodes",
    "search_group_by",
    "search_latest_version",
    "asset_summary",
    "format_name",
    "group_lookup",
    "missing_values",
    "validate_sets",
    "missing_boxes",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    memory = os.environ.get("BENCH_MEMORY", "12g")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory)
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
                "cpus": cpus,
                "memory": memory,
                "runs": runs,
                "sink": "noop",
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
