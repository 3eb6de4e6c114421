from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators import quality, risk, triage
from gaugeworks.streaming import duplicates
from gaugeworks.streaming import tickets as stream

SAMPLE = [
    dict(created_at=datetime(2025, 1, day), sla_due_at=datetime(2025, 1, day + 1), department=dept, priority="High")
    for day in range(1, 12) for dept in ("Billing", "Shipping")
]


def source(spark, tickets, folder, batches=3):
    for i in range(batches):
        tickets(*[dict(t, ticket_id=f"{i}-{j}") for j, t in enumerate(SAMPLE[i::batches])]).coalesce(1).write.parquet(
            f"{folder}/in", mode="append"
        )
    read = spark.readStream.schema(schemas.TICKETS).option("maxFilesPerTrigger", 1)
    return spark.read.parquet(f"{folder}/in"), read.parquet(f"{folder}/in")


def test_stream_equals_batch(spark, tickets, tmp_path):
    batch, live = source(spark, tickets, tmp_path)
    out = str(tmp_path / "out")
    stream.append_to(triage.triage(risk.add_risk(live)), out, str(tmp_path / "checkpoint")).awaitTermination()
    want = triage.triage(risk.add_risk(batch))
    got = spark.read.parquet(out)
    assert got.count() == len(SAMPLE) and got.exceptAll(want).isEmpty()


def test_windows_equal_batch(spark, tickets, tmp_path):
    batch, live = source(spark, tickets, tmp_path)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    # The files are not in order of time, so the watermark has to reach back over all of them.
    windows = stream.breach_windows(risk.add_risk(live), delay="30 days")
    stream.upsert_to(windows, out, checkpoint).awaitTermination()
    got = stream.latest_windows(spark, out)
    want = stream.breach_windows(risk.add_risk(batch), delay="30 days")
    assert got.count() == want.count() == 6
    assert got.exceptAll(want.select(got.columns)).isEmpty()


def test_late_rows_are_dropped(spark, tickets, tmp_path):
    folder = tmp_path / "in"
    read = spark.readStream.schema(schemas.TICKETS).option("maxFilesPerTrigger", 1).parquet
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for i, day in enumerate((1, 28, 1)):
        tickets(dict(created_at=datetime(2025, 1, day))).coalesce(1).write.parquet(str(folder), mode="append")
        windows = stream.breach_windows(risk.add_risk(read(str(folder))), delay="1 day")
        stream.upsert_to(windows, out, checkpoint).awaitTermination()
    assert sorted(r.total_tickets for r in stream.latest_windows(spark, out).collect()) == [1, 1]


def test_windows_do_not_depend_on_the_session_zone(spark, tickets):
    frame = risk.add_risk(tickets(dict(created_at=datetime(2025, 1, 1, 23)), dict(created_at=datetime(2025, 3, 30, 2, 30))))
    want = sorted(map(str, stream.breach_windows(frame, delay="1 day", window="1 day").collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(str, stream.breach_windows(frame, delay="1 day", window="1 day").collect())) == want
        assert "2025, 1, 1, 0, 0" in want[0] or "2025, 1, 1, 0, 0" in want[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_windows_over_split_orders_keep_every_ticket(spark, tmp_path):
    """Orders in several files, one a trigger and in no order of time: nothing is lost with a delay that covers them."""
    from gaugeworks.sources.driver_views import AS_OF, SCHEMAS, DriverViews

    small = "/root/testdata/sf0.001"
    orders = spark.read.schema(SCHEMAS["orders"]).parquet(f"{small}/orders.parquet")
    orders.repartition(4, F.col("o_orderkey") % 4).write.parquet(str(tmp_path / "orders"))
    live = spark.readStream.schema(SCHEMAS["orders"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "orders"))
    windows = stream.breach_windows(risk.add_risk(DriverViews(spark, small, orders=live).tickets, AS_OF), delay="4000 days")
    out = str(tmp_path / "out")
    stream.upsert_to(windows, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert stream.latest_windows(spark, out).agg(F.sum("total_tickets")).first()[0] == orders.count()


IDS = "ticket_id string, created_at timestamp_ntz, note string, n int"


def later_of(spark, folder, files, keep=timedelta(days=4000), delay="4000 days"):
    """The later rows of some files, one a trigger, in their order; the stream is stopped and started again between them."""
    for rows in files:
        spark.createDataFrame(rows, IDS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live = spark.readStream.schema(IDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        found = duplicates.later_rows(live, F.col("created_at"), delay, keep)
        stream.append_to(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(IDS).parquet(f"{folder}/out")


def test_later_rows_equal_the_batch(spark, tmp_path):
    day = lambda n: datetime(2025, 1, n)
    files = [
        [("a", day(5), "x", 1), ("a", day(5), "x", 1), ("b", day(2), None, None), (None, day(1), 'say "so"\n', 3), ("c", None, "", 0)],
        [("a", day(1), "é", 2), ("b", day(2), "y", 7), (None, day(1), "say", 3), ("hot", day(3), "0", 0)],
        [("hot", day(3), str(i % 7), i) for i in range(300)] + [("c", None, None, None), ("a", day(5), "x", 1)],
    ]
    got = Counter(map(tuple, later_of(spark, tmp_path, files).collect()))
    frame = spark.read.schema(IDS).parquet(f"{tmp_path}/in")
    want = Counter({tuple(r)[:-1]: r.later_occurrences for r in quality.duplicate_rows(frame).collect()})
    assert got == want and sum(got.values()) == quality.duplicate_count(frame).first()[0]


def test_ids_are_forgotten_after_a_while(spark, tmp_path):
    day = lambda n: datetime(2025, 1, n)
    files = [[("a", day(1), "1", 1)], [("a", day(2), "2", 2)], [("z", day(25), "", 0)], [("z", day(26), "", 0)], [("a", day(27), "3", 3)], [("a", day(27), "4", 4)]]
    got = later_of(spark, tmp_path, files, keep=timedelta(days=3), delay="1 day")
    assert sorted(r.note for r in got.collect()) == ["", "2", "4"]


def test_state_of_later_rows_is_held_in_buckets(spark, tmp_path):
    """Groups and state rows number as the buckets, not as the ids: a call of Python for each id took most of the time."""
    day = lambda n: datetime(2025, 1, n)
    for rows in ([(str(i), day(9), "x", i) for i in range(300)], [(str(i), day(9), "x", i - i % 2) for i in range(200, 500)]):
        spark.createDataFrame(rows, IDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(IDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = duplicates.later_rows(live, F.col("created_at"), "4000 days", timedelta(days=4000), buckets=8)
    query = stream.append_to(found, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(held) <= 8
    got = Counter(map(tuple, spark.read.schema(IDS).parquet(f"{tmp_path}/out").collect()))
    want = Counter({tuple(r)[:-1]: r.later_occurrences for r in quality.duplicate_rows(spark.read.schema(IDS).parquet(f"{tmp_path}/in")).collect()})
    assert got == want and sum(got.values()) == 100


def test_an_older_row_within_the_delay_keeps_the_newest_time(spark, tmp_path):
    day = lambda n: datetime(2025, 1, n)
    files = [[("a", day(10), "1", 1)], [("a", day(8), "0", 0)], [("z", day(16), "", 0)], [("a", day(14), "2", 2)]]
    got = later_of(spark, tmp_path, files, keep=timedelta(days=4), delay="3 days")
    assert sorted(r.note for r in got.collect()) == ["1", "2"]
