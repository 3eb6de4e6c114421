"""What is kept between runs: the window log, the reply log, the scored table; and counts over pieces of a text."""

import pytest
from pyspark.sql import functions as F
from small_tables import SMALL

from gaugeworks.functions.keywords import keyword_tokens, text_pieces
from gaugeworks.operators import briefing, matching, risk
from gaugeworks.operators.replies import complete
from gaugeworks.sources import reply_log, scored_table
from gaugeworks.sources.driver_views import AS_OF, DriverViews
from gaugeworks.sources.reply_log import ReplyLog
from gaugeworks.streaming.tickets import WindowLog

WINDOWS = "window_start string, window_end string, department string, total_tickets long, breached_tickets long"


def batch(spark, *rows):
    return spark.createDataFrame([(start, start + "+", "Billing", n, b) for start, n, b in rows], WINDOWS)


def partition_filters(frame):
    """What limits the folders of the first scan before it starts."""
    return frame._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def state(log):
    return sorted((r.window_start, r.total_tickets, r.breached_tickets) for r in log.latest().collect())


def test_window_log_reads_a_snapshot_and_later_batches(spark, tmp_path):
    log = WindowLog(spark, str(tmp_path))
    with pytest.raises(ValueError):
        log.latest()
    log.append(batch(spark, ("a", 1, 0), ("b", 2, 1)), 0)
    log.append(batch(spark, ("a", 3, 1)), 1)
    want = [("a", 3, 1), ("b", 2, 1)]
    assert state(log) == want and log.compact() == 1 and state(log) == want
    log.append(batch(spark, ("b", 5, 2)), 2)
    want = [("a", 3, 1), ("b", 5, 2)]
    assert state(log) == want
    files = log.latest().inputFiles()
    assert all("/snapshots/1-" in f or "/batches/id=2/" in f for f in files) and len({f.split("/part")[0] for f in files}) == 2
    log.drop_covered()
    assert log.batches() == [2] and state(log) == want
    # A batch that is sent again after it was compacted changes nothing.
    assert log.compact() == 2
    log.append(batch(spark, ("b", 5, 2)), 2)
    assert state(log) == want and log.compact() == 2


def test_window_log_survives_a_break_before_the_manifest(spark, tmp_path):
    log = WindowLog(spark, str(tmp_path))
    log.append(batch(spark, ("a", 1, 0)), 0)
    log.write_snapshot(0)  # and then the process ends
    again = WindowLog(spark, str(tmp_path))
    assert again.manifest() == (-1, None) and state(again) == [("a", 1, 0)]
    again.append(batch(spark, ("a", 2, 0)), 1)
    (tmp_path / "batches" / "id=2").mkdir()  # a batch that broke off has no _SUCCESS
    assert again.compact() == 1 and state(again) == [("a", 2, 0)]
    # A second compaction of the same batches loses the race and leaves the first one's manifest.
    named = again.manifest()
    again.publish(1, "elsewhere")
    assert again.manifest() == named


def test_reply_log_asks_each_prompt_once(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "z")], "id long, prompt string")
    log = ReplyLog(spark, str(tmp_path / "log"))
    assert log.ask(prompts.limit(0), lambda batch: batch) == 0
    # The first run breaks off after one part of three.
    some = prompts.where(F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(3)) == 0)
    first = log.ask(some, lambda batch: [p.upper() for p in batch])

    def fails(batch):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        log.ask(prompts, fails)
    again = ReplyLog(spark, str(tmp_path / "log"))
    assert first + again.ask(prompts, lambda batch: [p.upper() for p in batch], parts=2) == 3
    assert again.ask(prompts, fails) == 0
    again.clear_pending()
    assert sorted(r.reply for r in again.replies().collect()) == ["X", "Y", "Z"]
    got = {r.id: r.reply for r in again.answered(prompts, "id").collect()}
    assert got == {1: "X", 2: "Y", 3: "X", 4: None, 5: "Z"}


def test_reply_log_shuffles_no_prompts_that_are_all_open(spark, tmp_path, monkeypatch):
    """Which prompts are open is told by hashes and places; a log that has no reply yet gets its prompts as they were written."""
    prompts = spark.createDataFrame([(1, "x"), (2, "y"), (4, None), (5, "z")], "id long, prompt string")
    plans = []

    def seen(frame, *more):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return complete(frame, *more)

    monkeypatch.setattr(reply_log, "complete", seen)
    log = ReplyLog(spark, str(tmp_path / "log"))
    assert log.ask(prompts, lambda batch: batch, parts=2) == 3
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
    assert log.ask(prompts, lambda batch: batch) == 0 and len(plans) == 2


def test_scored_table_reads_only_the_files_it_needs(spark, tickets, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "scored")
    rows = [dict(ticket_id=f"T{i}", created_at=datetime(2025, 1 + i % 3, 1)) for i in range(60)] + [dict(ticket_id="T99", created_at=None)]
    scored = risk.add_risk(tickets(*rows))
    scored_table.store(scored, path, buckets=8)
    every = {r.ticket_id for r in spark.read.parquet(path).collect()}
    assert len(every) == 61
    month = scored_table.by_period(spark, path, "2025-02")
    assert {r.ticket_id for r in month.collect()} == {f"T{i}" for i in range(1, 60, 3)}
    assert "period#" in partition_filters(month)
    ids = spark.createDataFrame([("T5",), ("T5",), ("T99",), ("none",), (None,)], "ticket_id string")
    found = scored_table.by_ids(spark, path, ids, buckets=8)
    assert sorted(r.ticket_id for r in found.collect()) == ["T5", "T99"] and found.columns == scored.columns
    buckets = {r[0] for r in ids.where("ticket_id IS NOT NULL").select(scored_table.bucket_of(F.col("ticket_id"), 8)).collect()}
    filters = partition_filters(found)
    assert "bucket#" in filters and all(str(b) in filters for b in buckets) and len(buckets) <= 3
    assert scored_table.by_ids(spark, path, ids.limit(0), buckets=8).isEmpty()


def test_pieces_have_the_tokens_of_the_whole(spark):
    texts = ["Spark c++ spark. " * 7, "x" * 25 + " java", "++c++ .net node.js, sql", "ÄÖ sql-Query İİİ data", "a", "word" * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: r.w for r in frame.select("id", keyword_tokens(F.col("text")).alias("w")).collect()}
    for size in (1, 3, 7, 10):
        cut = text_pieces(frame, "text", size).select("id", "piece", keyword_tokens(F.col("text")).alias("w")).orderBy("id", "piece").collect()
        got = {i: [] for i in want}
        for row in cut:
            got[row.id] += row.w
        assert got == want, size


def test_long_texts_count_like_short_ones(spark):
    frame = spark.createDataFrame(
        [(1, "spark sql spark python "), (2, "java " * 30 + "scala"), (3, None), (4, ""), (4, "go rust go lang " * 9)], "id long, text string")
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    want = rows(matching.keyword_counts(frame, "id"))
    assert rows(matching.keyword_counts(frame, "id", long_chars=20)) == want


def test_one_text_of_50_mb(spark):
    unit = "spark engines need memory and spark jobs need tasks; "
    times = 50_000_000 // len(unit)
    frame = spark.range(1).select("id", F.concat(F.repeat(F.lit(unit), F.col("id").cast("int") + times), F.lit("finally")).alias("text"))
    counted = matching.keyword_counts(frame, "id", long_chars=matching.LONG_TEXT_CHARS)
    got = {r.keyword: (r.n, r.first_pos) for r in counted.collect()}
    assert got["spark"] == (2 * times, 0) and got["memory"] == (times, 3) and got["finally"][0] == 1
    per_unit = sum(n for n, _ in got.values()) - 1
    assert got["finally"][1] == per_unit and per_unit % times == 0


def test_facts_gather_no_level_in_one_task(spark):
    views = DriverViews(spark, SMALL)
    plan = briefing.facts(briefing.briefing_base(risk.add_risk(views.tickets, AS_OF)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "GlobalLimit" in plan
