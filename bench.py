"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

REPO = Path(__file__).resolve().parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ("fused_lineitem", "unique_key", "referential", "iqr", "numeric_profile", "duplicate_row", "spearman", "cramers_v", "top_values", "conditional")


def main() -> None:
    from pyspark.sql import SparkSession

    from veritrove import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        catalog.QUERIES[name](spark, sf).collect()
        runs = []
        for _ in range(2):
            t = time.time()
            catalog.QUERIES[name](spark, sf).collect()
            runs.append(time.time() - t)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total seconds of headline queries (best of 2, warm)", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
