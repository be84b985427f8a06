"""Runs the headline queries and prints one JSON line: seconds for each, and records and pairs a second."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from entitylink.plans import queries as linkage

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINE = ("normalize_unicode", "candidates_engine", "candidates_fast", "pair_features_fast", "threshold_sweep", "connected_components", "blocking_recall", "profile_source")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    linkage.QUERIES["profile_source"](spark, SF).collect()  # warm-up
    took, rows = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        df = linkage.QUERIES[name](spark, SF)
        rows[name] = df.count() if name == "profile_source" else _rows(df)
        took[name] = round(time.time() - began, 3)
        print(name, took[name], rows[name], file=sys.stderr, flush=True)
    rate = {f"{n}_rows_per_sec": round(rows[n] / took[n], 1) for n in took}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, "rates": rate, "sf": SF}))
    spark.stop()


def _rows(df) -> int:
    """All columns computed, rows counted in passing."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


if __name__ == "__main__":
    main()
