"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Each query runs once to warm up and is then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from assayer import checks
from assayer.session import build_session

HEADLINE = [
    "g1_join_group_order_limit", "g3_last_months", "g5_month_distinct", "g6_group_top", "g7_distinct_three_way",
    "g9_orders_without_items", "g10_aggregates", "g12_mixed_order", "g14_rank_of_groups", "q3_brace_subsets",
    "t2_last_fenced_statement", "t6_response_layouts", "t9_token_probabilities", "t10_model_cost", "d1_create_table_text",
    "d13_instructions_mysql", "d14_table_aliases", "d17_prompts", "w3_upsert", "w6_read_annotations", "m2_category_counts",
    "m4_running_accuracy", "m7_model_report", "e3_recurring_rows", "e7_sql_features", "e9_feature_totals",
    "c2_distinct_rows", "c12_exact_match_frames", "c17_subset_match_frames", "c17_subset_match_noise", "c18_score_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = checks.queries()
    picked = sys.argv[1:] or HEADLINE
    timed = {}
    for name in picked:
        seconds = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timed[name] = round(min(seconds), 3)
        print(f"{name:32s} {timed[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
