"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINES = ["e01_counts", "e02_ancestor_rollup", "e02_ancestor_rollup_corrected", "e03_source_rollup", "c08_overlap", "j04_search", "j08_places", "j12_localities", "j15_dossiers", "g10_dependency_closure", "m01_invalid_owners", "k11_aligned"]


def main() -> None:
    from palimpsest.plans.registry import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", f"{base}/shared").config("spark.local.dir", f"{base}/local").config("spark.sql.warehouse.dir", f"{base}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["j12_localities"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and reads once
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    shutil.rmtree(base, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
