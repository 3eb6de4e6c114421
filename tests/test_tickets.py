from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.operators import cleaning, measures, quality, risk, sla, support
from gaugeworks.plans import reports

DUE = datetime(2025, 1, 2)
LATER, EARLIER = DUE + timedelta(seconds=1), DUE - timedelta(hours=1)


def column(frame, name):
    return [r[name] for r in frame.orderBy("ticket_id").collect()]


def test_sla_status(tickets):
    frame = tickets(
        dict(closed_at=LATER), dict(closed_at=DUE), dict(closed_at=EARLIER), dict(), dict(sla_due_at=datetime(2027, 1, 1)),
        dict(sla_due_at=None), dict(sla_due_at=None, closed_at=LATER), dict(created_at=None, closed_at=EARLIER),
        dict(sla_due_at=C.AS_OF),
    )
    got = sla.add_sla(frame)
    on_track = "Open - On Track"
    assert column(got, "sla_status") == [
        "Breached", "Met", "Met", "Breached", on_track, on_track, "Met", "Met", on_track,
    ]
    assert column(got, "sla_breached") == [True, False, False, True] + [False] * 5
    assert column(got, "actual_resolution_hours")[2] == 23.0
    assert column(got, "actual_resolution_hours")[7] is None


def test_at_risk_is_optional(tickets):
    frame = tickets(dict(sla_due_at=C.AS_OF + timedelta(hours=3)), dict(sla_due_at=C.AS_OF + timedelta(hours=5)))
    assert column(sla.add_sla(frame, at_risk_hours=4), "sla_status") == ["At Risk", "Open - On Track"]


def test_bad_dates_raise_unless_lenient(tickets):
    bad = tickets(dict()).withColumn("created_at", F.lit("never"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sla.add_sla(bad).collect()
    assert sla.add_sla(bad, lenient=True).first()["created_at"] is None
    closed = tickets(dict()).withColumn("closed_at", F.lit("never"))
    assert sla.add_sla(closed).first()["closed_at"] is None


def test_risk_score(tickets):
    calm = dict(sla_due_at=datetime(2027, 1, 1))
    got = risk.add_risk(
        tickets(
            calm,  # Low 5 + Neutral 5 + on track 5
            dict(calm, priority="Unspecified"),
            dict(calm, previous_contacts=4), dict(calm, previous_contacts=5), dict(calm, previous_contacts=None),
            dict(calm, customer_rating=2), dict(calm, customer_rating=3), dict(calm, customer_rating=None),
            dict(priority="Critical", status="Escalated", customer_rating=1, previous_contacts=9,
                 customer_message="tired of waiting"),
        )
    )
    assert column(got, "escalation_risk_score") == [15, 10, 35, 35, 15, 25, 15, 15, 100]
    assert column(got, "risk_level") == ["Low"] * 8 + ["High"]


def test_risk_level_edges(spark):
    from gaugeworks.functions.numeric import band

    scores = spark.createDataFrame([(s,) for s in (0, 39, 40, 69, 70, 100, -5)], "s int")
    got = [r[0] for r in scores.select(band(F.col("s"), *C.RISK_BAND)).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High", "nan"]


def test_scores_are_bounded_and_agree_with_levels(spark):
    from small_tables import SMALL
    from gaugeworks.sources.driver_views import AS_OF, DriverViews

    scored = risk.add_risk(DriverViews(spark, SMALL).tickets, AS_OF)
    wrong = scored.where(
        "escalation_risk_score NOT BETWEEN 0 AND 100 OR (risk_level = 'High') <> (escalation_risk_score >= 70)"
    )
    assert wrong.isEmpty()


def test_scoring_is_one_projection(tickets):
    plan = risk.add_risk(tickets(dict()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def summary_tickets(tickets):
    return tickets(
        dict(agent="Ava", closed_at=LATER, customer_rating=1), dict(agent="Ava", closed_at=EARLIER, customer_rating=2),
        dict(agent="Noah", customer_rating=None, department="Shipping"), dict(agent=None, ticket_id=None),
    )


def test_summaries(tickets):
    scored = risk.add_risk(summary_tickets(tickets))
    agents = [tuple(r) for r in support.agent_performance(scored).collect()]
    assert agents == [("Ava", 2, 23.5, 50.0, 1.5, 0), ("Noah", 1, None, 100.0, None, 0)]
    kpis = support.kpis(scored).first()
    assert (kpis.total_tickets, kpis.open_tickets, kpis.sla_breach_rate) == (4, 4, 75.0)
    assert kpis.avg_customer_rating == 2.33
    # Ids are counted, a missing one is not.
    assert {r.department: r.total_tickets for r in sla.sla_summary(scored).collect()} == {"Billing": 2, "Shipping": 1}


def test_summaries_of_a_rollup_are_the_same(spark):
    from small_tables import SMALL
    from gaugeworks.sources.driver_views import AS_OF, DriverViews

    scored = risk.add_risk(DriverViews(spark, SMALL).tickets, AS_OF)
    rolled = measures.rollup(scored, "department", "issue_type", "agent")
    for summary in (support.kpis, support.agent_performance, support.issue_summary, support.root_causes, sla.sla_summary):
        assert summary(scored).collect() == summary(rolled).collect()
    total = scored.count()
    assert sum(r.total_tickets for r in support.root_causes(rolled).collect()) == total
    assert sum(r["count"] for r in support.risk_histogram(scored).collect()) == total


def test_empty_input(tickets):
    scored = risk.add_risk(tickets())
    kpis = support.kpis(scored).first()
    assert kpis.total_tickets == 0 and kpis.sla_breach_rate is None
    assert support.agent_performance(scored).isEmpty() and risk.top_risk_tickets(scored).isEmpty()


def test_top_risk_tickets(tickets):
    scored = risk.add_risk(tickets(dict(), dict(priority="High"), dict(priority="High"), dict(priority="Critical")))
    top = risk.top_risk_tickets(scored, 3)
    assert [r.ticket_id for r in top.collect()] == ["T4", "T2", "T3"]
    assert tuple(top.columns) == risk.TOP_COLUMNS
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_overloaded_agents(spark):
    rows = [("both", 10, 5), ("volume", 10, 1), ("risky", 1, 5), ("light", 1, 1), ("mean", 5, 3)]
    agents = spark.createDataFrame(rows, "agent string, total_tickets bigint, high_risk_tickets bigint")
    got = {r.agent: r.workload_reason for r in support.overloaded_agents(agents).collect()}
    # The means are 5.4 and 3.0: an agent at the mean is not above it.
    assert got == dict(zip(("both", "volume", "risky"), C.WORKLOAD_REASONS))


def test_customers_to_contact(tickets):
    scored = risk.add_risk(
        tickets(
            dict(customer_id="calm"), dict(customer_id="upset", customer_message="tired", sla_due_at=datetime(2027, 1, 1)),
            dict(customer_id="late", customer_message="cancel"),
        )
    )
    assert [r.customer_id for r in support.customers_to_contact(scored).collect()] == ["late", "upset"]


def test_sql_report_counts_only_closed_late_tickets(tickets):
    row = reports.breach_rate_by_department(tickets(dict(), dict(closed_at=LATER), dict(closed_at=EARLIER), dict())).first()
    assert (row.total_tickets, row.sla_breach_rate) == (4, 25.0)


def test_dataset_summary_finds_columns_by_name(spark):
    frame = spark.createDataFrame([("A", True), ("A", False), ("B", True)], "Home_Department string, is_SLA_Breach boolean")
    row = support.dataset_summary(frame, "{tickets}/{rate}/{department}").first()
    assert row.summary == "3/66.7/A"
    bare = support.dataset_summary(frame.select(F.lit(1).alias("x")), "{tickets}/{rate}/{department}").first()
    assert bare.summary == "3/N/A/N/A"


def test_column_checks(spark):
    frame = spark.createDataFrame([], "ticket_id string, vendor string")
    check = cleaning.check_columns(frame)
    assert not check.passed and check.missing[0] == "customer_id" and len(check.missing) == 13
    assert cleaning.check_cost_columns(frame).missing == [
        "actual_amount", "budget_amount", "cost_category", "date", "department",
    ]
    with pytest.raises(ValueError, match="customer_id"):
        cleaning.require_columns(frame)


def test_cleaning(spark):
    frame = spark.createDataFrame(
        [(" T1\t", "2.7", None, "n/a"), ("T2", None, "x", None)],
        "` ticket_id ` string, customer_rating string, previous_contacts string, status string",
    )
    got = cleaning.clean_tickets(frame)
    assert got.columns == ["ticket_id", "customer_rating", "previous_contacts", "status"]
    assert [tuple(r) for r in got.collect()] == [("T1", 2, 0, "n/a"), ("T2", 3, 0, None)]


RAW = ", ".join(f"{c} string" for c in C.REQUIRED_TICKET_COLUMNS)
GOOD = dict(
    ticket_id="T", customer_id="C", department="D", issue_type="I", priority="Low", agent="A", channel="Email",
    created_at="2025-01-01", sla_due_at="2025-01-02", closed_at="2025-01-02 10:00:00", status="Open",
    previous_contacts="0", customer_message="hi", customer_rating="3",
)


def raw(spark, *changes):
    rows = [tuple({**GOOD, "ticket_id": f"T{i}", **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, RAW)


def test_quality_of_good_data(spark):
    row = quality.quality_report(raw(spark, {}, {})).first()
    assert (row.quality_score, row.issues) == (100, [C.NO_ISSUES_LINE])


def test_quality_counters(spark):
    row = quality.quality_report(
        raw(
            spark, dict(ticket_id="x"), dict(ticket_id=None), dict(ticket_id=None), dict(ticket_id="x"),
            dict(priority=None), dict(priority="low"), dict(status="closed"), dict(created_at="never"),
            dict(sla_due_at=None), dict(closed_at=None), dict(closed_at="soon"), dict(customer_message=" \t"),
            dict(customer_message=None),
        )
    ).first()
    assert row.duplicate_ticket_count == 2
    assert row.invalid_priority_count == 2
    assert row.invalid_status_count == 1
    assert row.invalid_date_count == 3
    assert row.missing_message_count == 2
    assert row.missing_value_total == 6
    assert row.quality_score == 100 - 4 - 4 - 2 - 6 - 2 - 0
    assert row.issues == [
        "2 duplicate ticket IDs found", "2 invalid priority values found", "1 invalid status values found",
        "3 invalid date values found", "2 missing customer messages found", "6 total missing values found",
    ]


def test_quality_penalties_are_capped(spark):
    bad = dict(ticket_id="x", priority="?", status="?", created_at="?", customer_message="")
    row = quality.quality_report(raw(spark, *[bad] * 40)).first()
    assert row.quality_score == 100 - 20 - 15 - 15 - 20 - 15
    empty = quality.quality_report(raw(spark)).first()
    assert (empty.total_rows, empty.quality_score) == (0, 100)


def test_quality_of_partial_columns(spark):
    row = quality.quality_report(spark.createDataFrame([(1.0,), (float("nan"),)], "x double")).first()
    assert (row.missing_value_total, row.duplicate_ticket_count, row.quality_score) == (1, 0, 100)


def test_duplicate_rows(spark):
    frame = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "p"), (None, None, "q"), ("a", 2, "x")],
        "ticket_id string, created_at int, note string",
    )
    got = {tuple(r) for r in quality.duplicate_rows(frame).collect()}
    assert got == {("a", 2, "x", 2), ("a", 1, "y", 1), (None, 1, "p", 1)}
    assert sum(g[3] for g in got) == quality.duplicate_count(frame).first()[0]


def test_duplicates_of_a_hot_id_against_brute_force(spark):
    """A third of the rows under one id, half of those equal copies; few or many repeated ids give the same result."""
    rows = [("hot", 5, "copy")] * 100 + [("hot", i % 7, f"n{i}") for i in range(100)] + [(f"t{i // 2}", i, "x") for i in range(400)]
    frame = spark.createDataFrame(rows, "ticket_id string, created_at int, note string").repartition(4)
    seen, want = set(), {}
    for r in sorted(rows):
        if r[0] in seen:
            want[r] = want.get(r, 0) + 1
        seen.add(r[0])
    assert {tuple(r)[:3]: r.later_occurrences for r in quality.duplicate_rows(frame).collect()} == want
    assert {tuple(r)[:3]: r.later_occurrences for r in quality.duplicate_rows(frame, rows_per_part=10).collect()} == want


def test_times_of_several_forms(spark, tickets):
    frame = spark.createDataFrame(
        [("01/15/2025 10:00", "01/15/2025 12:00", "01/16/2025 12:00"), ("2025-01-15 10:00:00", "2025-01-15 12:00:00", None)],
        "created_at string, sla_due_at string, closed_at string",
    )
    formats = ("MM/dd/yyyy HH:mm",)
    got = sla.add_sla(frame, datetime(2025, 1, 15, 11), formats=formats).collect()
    assert [(r.sla_status, r.actual_resolution_hours) for r in got] == [("Breached", 26.0), ("Open - On Track", None)]
    assert quality.quality_report(frame, formats).first().invalid_date_count == 0
    assert quality.quality_report(frame).first().invalid_date_count == 3
    with pytest.raises(Exception):
        sla.add_sla(frame, formats=("yyyy/MM/dd",)).collect()


def test_sums_of_hours_do_not_depend_on_order(spark):
    from gaugeworks.operators import measures

    frame = spark.range(20_000).select(
        F.col("id").cast("string").alias("ticket_id"), (F.col("id") % 7).cast("string").alias("department"),
        (F.col("id") % 3).cast("string").alias("agent"), (F.expr("id % 1013 * 1234567") / F.lit(3.6e9)).alias("actual_resolution_hours"),
        F.lit(False).alias("sla_breached"),
    )
    exact = lambda f: sorted(map(tuple, measures.rollup(f, "department").select("department", "m_hours").collect()))
    direct = exact(frame)
    assert direct == exact(frame.repartition(13)) == exact(measures.rollup(frame.orderBy(F.desc("id")), "department", "agent"))
