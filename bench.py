"""Times the headline queries; prints one JSON line.

Every query runs once untimed first, so the times leave out JVM warm-up and code generation.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma-separated names, or ``all``) select what runs.
"""

from __future__ import annotations

import json
import os
import time

from framewright.plans import all_queries
from framewright.session import get_spark

HEADLINE = (
    "throttle grouped_within session_history session_gate chunk_stream_total request_reply_fifo "
    "host_failure_breaker annotations balanced_sample percent_split seeded_shuffle fixed_batches "
    "batch_inference decode_messages client_frame_counters background_subtraction "
    "stream_throttle stream_session_machine"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    seconds = {}
    for timed in (False, True):
        for name in names:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
