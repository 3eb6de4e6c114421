"""Time the headline queries and print one JSON line.

Each query is planned and run in full (result written to the `noop` sink) once to warm up, then BENCH_RUNS times; its
time is the median. Nothing is cached between runs.
"""

import json
import os
import statistics
import sys
import time

import registered
from gaugeworks.session import build_session, clear_scratch

HEADLINE = (
    "sla_by_department", "sql_breach_rate", "scored_tickets", "support_kpis", "agent_performance", "issue_summary",
    "root_cause", "top_risk_tickets", "overloaded_agents", "clean_tickets", "quality_report", "duplicate_rows",
    "ticket_triage", "recommendations", "daily_briefing", "findings", "support_questions", "cost_analysis", "cost_totals",
    "cost_by_department", "vendor_share", "cost_report", "redacted_documents", "keyword_counts", "resume_match",
    "validated_feedback", "merged_triage", "stream_scored_tickets", "candidate_prompts", "triage_prompts", "feedback_report",
    "customers_to_contact", "csv_roundtrip", "stream_breach_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false",
           # The tables are small: keep all cores busy after a shuffle of little data.
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        clear_scratch(spark)
    print(json.dumps({
        "metric": "sum of the median times of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
