"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pressroom.plans import QUERIES
from pressroom.session import build_session

# Heavy and typical operators of each area; BENCH_QUERIES=all runs every query.
HEADLINE = (
    "s1_article_scan", "p3_title_search", "l3_article_page", "l4_page_numbers", "a4_monthly_users",
    "j1_comments_with_articles", "j3_comment_threads", "a6_comment_counters", "t2_moderation_text",
    "t3_sentiment_text", "a12_vocabulary", "c1_count_vectors", "c3_fit_words", "c4_predict",
    "c8_cross_validation", "c10_decisions", "a8_sentiment_statistics", "c13_apply_verdicts",
    "x2_article_extraction", "x5_site_limit", "d1_near_duplicates", "d2_title_dedupe",
    "d3_new_article_ids", "d5_article_intake", "m1_review_articles", "m3_toggle_users",
    "m8_register_users", "m9_add_comments", "m10_like_comments", "r1_moderation_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            # The test files are single row groups.
            "spark.pressroom.spreadTasks": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["t5_serving_words"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}
        )
    )


if __name__ == "__main__":
    main()
