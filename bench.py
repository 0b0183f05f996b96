"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import importlib.util
import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "chunk_documents", "tenant_dashboard", "keyword_multi_term", "keyword_batch_topk", "semantic_topk", "semantic_batch_topk", "fts_postings", "fts_bm25_topk",
    "header_footer_removed", "markdown_bundle", "sqlite_export_rows", "sqlite_export_bytes", "semantic_ann_topk", "markdown_bundle_pieces", "file_dispatch",
    "op1_mixing", "op2_lm_scoring", "op3_topk", "op4_simhash", "op5_toxicity", "op6_hnsw", "op7_secrets", "op8_language_id", "op9_packing", "op10_html_extraction", "op11_suffix_dedup", "op12_repair", "op13_merkle",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = entry.queries(), {}
    for name in HEADLINE:
        if name in queries:
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
