"""Time the headline queries: one warm-up and the best of two runs each, into a sink that discards the rows.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from articleflow.plans.queries import QUERIES

HEADLINES = (
    "report_metrics", "report_metrics_by_category", "report_cube", "category_counts", "top_sources", "daily_counts",
    "daily_event_counts", "filter_keyword", "filter_combined", "list_page", "page_count", "dedup_raw_first_wins",
    "raw_inserts", "fetch_run_stats", "merge_skip", "merge_upsert", "merge_stats", "duplicate_content_groups",
    "clean_rows", "normalized_documents", "normalized_pages", "normalized_urls", "normalized_dates", "strip_html_pages",
    "extract_articles", "extract_links_all", "crawl_pages", "feed_items", "robots_allowed", "fetch_slots",
    "redacted_documents", "analysis_blocks", "analysis_prompts", "summary_prompts", "summaries", "parsed_analysis",
    "latest_analysis", "export_csv", "export_jsonl", "stream_raw_inserts", "stream_clean", "stream_daily_trend", "stream_distinct_urls",
    "clean_run",
)


def timed(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("articleflow-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        query = QUERIES[name]
        timed(query, spark, sf_dir)
        seconds[name] = round(min(timed(query, spark, sf_dir) for _ in range(2)), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
