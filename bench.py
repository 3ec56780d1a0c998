"""Times the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillframe.queries import PAIRS, session

HEADLINE = [
    "scan_filter", "between_in", "like_contains", "case_when", "semi_in", "anti_not_in", "scalar_subquery", "join_inner", "join_left", "join_three", "agg_basic", "statistics", "mode", "group_concat", "distinct_agg", "pivot_case", "having",
    "rollup", "cube", "grouping_sets", "rollup_report", "rank_family", "lag_lead", "running_rows", "share_of_total", "top_n_per_group", "topk", "union_chain", "cte_join", "gap_fill", "fn_strings", "fn_dates", "fn_numbers", "events_by_hour",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    s = session(spark, sf_dir)
    times: dict[str, float] = {}
    for warm in (True, False):
        for name in HEADLINE:
            began = time.perf_counter()
            s.sql(PAIRS[name][0]).write.format("noop").mode("overwrite").save()
            if not warm:
                times[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
