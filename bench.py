"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quern.workloads.queries import QUERIES

NAMES = ("q1", "q3", "q5", "q6", "q7", "q10", "q3_spj", "q5_spj", "q10_spj", "ssb_q1_1", "ssb_q2_1", "ssb_q3_1", "ssb_q4_1", "join_theta_equi", "join_chain6", "joins_of_all", "log_replay_latest", "resume_units")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # the first compiles
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total of warm medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
