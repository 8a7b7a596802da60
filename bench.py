"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm the JVM (on the same data) and once measured; results go to the no-op sink, so every
row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import local_session
from checks.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
HEADLINE = [
    "k01_repositories",
    "k02_file_signals",
    "k03_snippets",
    "k04_commit_history",
    "d03_attribution_01",
    "e24_high_comment_ratio",
    "e40_feature_list",
    "f02_low_burstiness",
    "f04_zipf_fit",
    "f06_repeated_2grams",
    "g02_predictability",
    "h01_commit_scores",
    "h11_commit_bursts",
    "i05_category_totals",
    "a07_file_cap",
    "a12_file_history",
    "c08_positional_ngrams",
]


def timed(spark, key: str) -> float:
    start = time.time()
    QUERIES[key](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    spark = local_session(CPUS)
    seconds = {}
    for key in HEADLINE:
        timed(spark, key)
        seconds[key] = round(timed(spark, key), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
