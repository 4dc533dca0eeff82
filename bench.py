"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidence_lake.plans import all_queries  # noqa: E402
from evidence_lake.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(all_queries())
    spark = local_session(cpus, app="bench")
    # Start the executor threads and the Python workers before anything is timed.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).mapInArrow(lambda batches: batches, "id BIGINT").collect()
    times: dict[str, float] = {}
    for name in names:
        started = time.time()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "all queries of the catalogue, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
