"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

#: Rotation windows, as-of joins at 2 and 24 hours, hourly full outer join and rolling means,
#: the two-hop frame filtered per slice and written once, and the quality profile.
HEADLINE = [
    "W01_W05_rotation", "W01_lag_columns", "W03_two_hop", "W07_rolling_place", "J02_asof_departure", "J02_asof_departure_24h",
    "J02_asof_bucketed", "J08_full_outer", "A01_hourly_departures", "A03_route_hours", "A07_describe", "A47_patterns", "L04_year_splits",
]


def main() -> None:
    from waypath.plans import catalog
    from waypath.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, partitions=2 * int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        queries[name](spark, sf_dir).limit(1).collect()  # warm up
        best = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
