"""Benchmark of the headline queries.

Runs each query to completion through Spark's ``noop`` sink (every row is
produced, nothing is collected to the driver) on ``local[$BENCH_CPUS]`` over
``$BENCH_SF_DIR`` and prints one JSON line. Each query runs ``$BENCH_REPEAT``
times after one warm-up pass; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakejobs.plans import registry  # noqa: E402
from lakejobs.session import build_session  # noqa: E402

HEADLINE = [
    "silver_user_events", "gold_event_daily", "gold_user_country", "silver_day_range",
    "sql_join_inner", "sql_agg", "sql_distinct", "sql_topn_group", "sql_lag", "sql_setops",
    "sql_subquery", "sql_array",
    "obs_usage", "obs_readiness", "obs_service_status", "obs_events", "obs_tail",
    "cfg_props", "tbl_fields", "tbl_partitions",
    "vector_embed", "vector_topk", "vector_topk_approx", "vector_upsert",
    "ingest_replay", "pipeline_run", "obs_rate", "obs_follow", "obs_export", "obs_pods",
    "sql_rank", "sql_frame", "external_files",
]


def run_once(spark, name, sf_dir):
    t = time.perf_counter()
    df = registry.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                          app_name="lakejobs-bench")
    for n in names:                     # warm-up: JIT, Python workers, file listing
        run_once(spark, n, sf_dir)
    times = {}
    for n in names:
        times[n] = round(statistics.median(run_once(spark, n, sf_dir) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
