"""Headline queries on one data directory; prints one JSON line."""
import json
import os
import time

from maskloom import plans
from maskloom.session import get_spark

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["tile_01", "join_04", "tile_label_counts", "mask_02", "mask_03", "mask_05", "win_10", "nms_01", "nms_02", "nms_03",
            "agg_01", "agg_03", "join_02", "join_14", "cur_01", "snk_09_labels", "win_11", "snk_01"]


def main():
    spark = get_spark(f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": str(2 * int(CPUS)), "spark.driver.memory": "20g",
                                                   "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["prj_05"](spark, SF_DIR).collect()  # start the JVM outside the timings
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        plans.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "mask dataset queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
