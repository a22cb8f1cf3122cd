"""Wall seconds of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "P2_pair_report", "H2_render_pairs", "C2_object_relations", "P1_atomic_facts", "E8_group_split", "E12_yes_no_balanced", "E17_hard_negatives",
    "P5_spatial_rows", "P6_record_rows", "P10_clean_boxes", "P10_clean_counts", "D11_metrics_strict", "D14_flips", "D18_auroc", "D19_average_precision",
    "D20_best_threshold", "D22_describe", "D4_cooccurrence", "D9_dataset_profile", "G3_prototypes", "G5_head_scores", "G7_prototype_evaluation",
    "G13_condition_balanced", "G24_alignment", "F3_leakage", "F5_head_overlap", "H5_answer_parsers", "H8_router_weights", "B4_text_cleaning", "A13_ordered_fingerprint",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pairloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pairloom.plans.catalog import QUERIES

    names = sys.argv[1:] or [n for n in HEADLINE if n in QUERIES]
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    out = {"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
