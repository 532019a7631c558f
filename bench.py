"""Times every query over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one line of JSON.

``BENCH_QUERIES`` (comma separated) picks some of them; each result is computed in full and thrown away.
"""

import json
import os
import platform
import time

import pyspark

from gitgauge.plans.catalog import queries
from gitgauge.session import local_session


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=os.environ.get("BENCH_PARTITIONS", "8"))
    registered = queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads
    seconds = {}
    for name in wanted or registered:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of all queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
        "spark": pyspark.__version__, "python": platform.python_version(),
    }))


if __name__ == "__main__":
    main()
