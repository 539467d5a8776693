"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of threads. Each query
is run to completion into the ``noop`` sink, so all rows and columns are computed
but none travel to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parvis.catalog import all_queries
from parvis.session import local_session

HEADLINE = [
    "clean_pipeline", "iqr_by_district", "under_priced_sales", "hidden_gems", "gem_search_batch", "market_summary",
    "district_breakdown", "box_stats", "transaction_page", "street_trailing_median", "feature_frame", "training_frame",
    "scorecard_by_model", "residuals_by_segment", "gem_score_listings", "price_corrections", "request_validation",
    "poi_counts", "grid_enrichment", "visible_text", "listing_extract", "listing_features", "vision_normalise",
    "isolation_forest", "linear_model_scores", "gbt_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "parvis-bench", **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session's threads
    queries, seconds = all_queries(), {}
    for name in chosen:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
