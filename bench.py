"""Time the headline queries on one local session and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once to warm up, then BENCH_RUNS times; the median is reported. Every run plans
the query afresh and computes every output column into a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from opinara.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "scan_reviews",
    "ingest",
    "source_cut",
    "dedup_reviews",
    "anti_new_reviews",
    "enrich",
    "reader_all",
    "overview_per_game",
    "sentiment_share",
    "kpis",
    "trend_score",
    "trend_themes",
    "trend_themes_abs",
    "trend_sentiment",
    "trend_vol",
    "weekly_agg",
    "weekly_sample",
    "report_prompt",
    "weekly_report",
    "latest_reports",
    "game_cards",
    "upsert_games_config",
    "upsert_reports",
    "validate_packages",
    "stream_enrich",
)


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(
            statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 3
        )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rate = round(rows / seconds["stream_enrich"]) if "stream_enrich" in seconds else None
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "stream_enrich_rows_per_sec": rate,
            }
        )
    )


if __name__ == "__main__":
    main()
