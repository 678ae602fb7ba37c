"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores (default 8), BENCH_QUERIES optionally
a comma-separated choice of queries. Every query runs to its last row; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import time

from siftline.plans.catalog import QUERIES
from siftline.session import local_session

HEADLINE = (
    "log_keys", "params", "time_delta", "access_parse", "rules_bulk", "rules_multi", "rules_fields", "rules_first",
    "attack_overview", "category_counts", "timeline", "attack_chains", "brute_force_window", "next_key_model",
    "key_anomalies", "param_anomalies", "detect", "metrics", "transitions", "cooccurrence", "tasks_model",
    "file_scan_score", "flow_lines",
)


def input_rows(spark, sf_dir: str) -> dict[str, int]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "orders", "lineitem", "pages")}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    sizes = input_rows(spark, sf_dir)
    mixed = 4 * sizes["events"] + sizes["orders"]
    lines_of = {
        "log_keys": mixed, "params": mixed, "rules_multi": mixed, "rules_fields": mixed, "rules_first": mixed,
        "category_counts": mixed, "rules_bulk": sizes["lineitem"], "flow_lines": sizes["lineitem"],
        "file_scan_score": sizes["pages"],
    }
    seconds, rates = {}, {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        rates[name] = round(lines_of.get(name, sizes["events"]) / seconds[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
