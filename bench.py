"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs once to warm up
and is then timed; the result is written to Spark's no-op sink, so that all of its rows are made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINES = [
    "B1_clean_text", "B4_text_statistics", "C2_lexical_richness", "C13_extract_features", "C14_profile_comparison",
    "D1_perplexity", "D5_ngram_repetition", "D14_ensemble", "E4_lexical_pairs", "E6_similar_pairs", "E9_batch_nearest",
    "F2_first_wins", "F3_combined_detection", "F11_cross_owner_plagiarism", "F13_owner_rollup_vectors", "G2_authorship_score",
    "I2_profile_initialisation", "J2_enriched_listing", "K10_admin_totals", "L9_intrusion_score", "N4_token_state",
    "O3_rate_series", "O6_load_summary", "Q3_rate_limit_sessions", "Q5_login_lockout",
]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    from scriptoria.plans import QUERIES
    from scriptoria.session import build_session, drop_staged

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        run(name)
        times = []
        for _ in range(repeats):
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        drop_staged(spark)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark_version, partitions = spark.version, spark.conf.get("spark.sql.shuffle.partitions")
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "spark": spark_version, "master": f"local[{cpus}]",
        "shuffle_partitions": int(partitions),
    }))


if __name__ == "__main__":
    main()
