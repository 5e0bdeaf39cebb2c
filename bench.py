"""Warm seconds of every engine query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftline.queries import queries  # noqa: E402
from driftline.session import session  # noqa: E402


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in queries().items():
        run = lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()  # compiles code and reads footers
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "warm seconds of all engine queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
