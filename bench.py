"""Headline timings.  Prints one JSON line; median of BENCH_RUNS runs after one warm-up.

``parts`` splits each time into building the DataFrame (with its stored steps), planning and running.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from itertools import pairwise

from pyspark.sql import functions as F

from redactlake.operators import pages as P
from redactlake.operators import redaction as X
from redactlake.operators import review as W
from redactlake.operators import scopes as C
from redactlake.operators import tokens as T
from redactlake.plans.tables import table
from redactlake.session import build_session
from redactlake.sources import html as H
from redactlake.sources import resolve

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def jobs(spark):
    docs, pages, events, talks = (table(spark, FOLDER, t) for t in ("documents", "pages", "events", "conversations"))
    turns = talks.select(F.col("conv_id").alias("scope"), F.col("turn").alias("item_ord"), "text").repartition(int(CPUS))
    spread = docs.repartition(int(CPUS))  # the table is one small file here; large tables have many splits
    keys = ["doc_id", "lang"]
    return {
        "find_entities": lambda: X.find_entities(spread, keys),
        "entity_counts": lambda: T.entity_counts(X.find_entities(spread, keys), ["lang", "kind"], ["doc_id"]),
        "redact_numbered": lambda: X.redact_rows(spread).select("doc_id", "redacted"),
        "redact_hash": lambda: X.redact_rows(spread, style="hash", salt="bench").select("doc_id", "redacted"),
        "leak_audit": lambda: X.leak_audit(spread, "text"),
        "corpus_tokens": lambda: T.assign_tokens(
            X.find_entities(spread, ["doc_id"]).withColumnRenamed("doc_id", "item_ord"), [], aliases=False
        ),
        "page_chunks": lambda: H.page_chunks(pages.repartition(int(CPUS))),
        "page_nodes": lambda: H.page_nodes(pages.repartition(int(CPUS))),
        "redact_scopes": lambda: C.redact_scopes(turns, ["scope"])[0],
        "page_headings": lambda: resolve.page_texts(resolve.resolved_pages(pages.repartition(int(CPUS)))),
        "debounce": lambda: W.debounce(
            events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", "30 MINUTE"
        ),
        "recent_events": lambda: W.recent_audit(
            events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id"
        ),
    }


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    parts: dict[str, list[float]] = {}
    for name, build in jobs(spark).items():
        runs = []
        for i in range(RUNS + 1):
            marks = [time.perf_counter()]
            df = build()
            marks.append(time.perf_counter())
            df._jdf.queryExecution().executedPlan()
            marks.append(time.perf_counter())
            df.write.format("noop").mode("overwrite").save()
            marks.append(time.perf_counter())
            if i:
                runs.append([b - a for a, b in pairwise(marks)])
        parts[name] = [round(statistics.median(r[k] for r in runs), 3) for k in range(3)]
        times[name] = round(statistics.median(map(sum, runs)), 3)
        print(name, times[name], parts[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "parts": parts, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
