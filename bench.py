"""Time every registered query. Prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     threads of the local master (default 8)
BENCH_QUERIES  comma-separated keys (default all)
BENCH_RUNS     runs per query, of which the fastest counts (default 2)

Building the household table that the queries read is timed on its own, once, as ``household_table``;
fitting the model counts in ``train_gbt``, once. Every other time is from calling the query to the last
row written to a sink that drops it.
"""

import json
import os
import time

from bundlelens.plans.registry import benchmark, queries
from bundlelens.session import build_session


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__driver__host="127.0.0.1", spark__driver__bindAddress="127.0.0.1",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # Starting the JVM's first job is not counted.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {"household_table": timed(lambda: benchmark(spark, sf_dir).limit(1))}
    for key, query in queries().items():
        if not wanted or key in wanted:
            repeat = 1 if key == "train_gbt" else runs
            times[key] = min(timed(lambda: query(spark, sf_dir)) for _ in range(repeat))
    spark.stop()
    name = os.path.basename(sf_dir)
    print(json.dumps({"metric": "total seconds over all queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()},
                      "sf": float(name[2:]) if name.startswith("sf") else name, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
