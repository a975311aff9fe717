"""Times the headline queries; prints one line of JSON."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from typeloom.operators.catalogue import QUERIES  # noqa: E402

HEADLINE = ["infer_lineitem", "infer_dts", "infer_conversations", "field_presence", "alias_column", "alias_histogram", "check_totals", "check_type_stats", "patch_replay_append", "patch_replay_set", "scan_parse", "hoist_shared"]


def check_files_seconds(spark: SparkSession, sf_dir: str, files: int = 65) -> float:
    """Seconds to check the events, written as so many JSON-lines files, against declarations."""
    from typeloom.operators.check import check_files

    schema = "export type Event = { event_id: number; ts: string; user_id: number; event_type: string; value: number; props: string };\n"
    with tempfile.TemporaryDirectory() as folder:
        spark.read.parquet(f"{sf_dir}/events.parquet").repartition(files).write.json(f"{folder}/in")
        began = time.perf_counter()
        assert check_files(spark, [f"{folder}/in/*.json"], schema).passed
        return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    seconds["check_65_files"] = round(check_files_seconds(spark, sf_dir), 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "infer_records_per_sec": round(rows / seconds["infer_lineitem"])}))


if __name__ == "__main__":
    main()
