"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from playseq.session import builder

HEADLINES = (
    "scoreboard_lag",
    "infer_pat",
    "stuck_clock_repair",
    "monotone_clock",
    "fill_field_position",
    "ep_autofix",
    "gap_placeholders",
    "check_issues",
    "alert_dedup",
    "canonical_names",
    "week_games_days",
    "matchups",
    "latest_snapshot",
    "json_games",
    "json_plays",
    "full_pipeline",
    "historical_qc",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder(
            "bench",
            spark__sql__shuffle__partitions=cpus,
            spark__ui__enabled="false",
            spark__ui__showConsoleProgress="false",
            spark__driver__memory="16g",
        )
        .master(f"local[{cpus}]")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from playseq.plans.catalog import QUERIES

    spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
