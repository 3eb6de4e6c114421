from decimal import Decimal

from gaugeworks import schemas
from gaugeworks.operators import spend
from gaugeworks.sources.tables import inline_costs

ROW = ("2026-01-01", "IT", "Cloud", "Vendor A", 100, 110, "P", "US", "O", "U")


def costs(spark, *amounts):
    return inline_costs(spark, [ROW[:4] + amount + ROW[6:] for amount in amounts])


def test_inline_costs(spark):
    frame = costs(spark, (100, "110.5"))
    assert frame.schema == schemas.COSTS
    assert frame.first().actual_amount == Decimal("110.50")


def test_variance_bands(spark):
    cases = {
        (10000, 10504): (5.0, "Low"), (10000, 10506): (5.1, "Medium"), (1000, 1150): (15.0, "Medium"),
        (1000, 1151): (15.1, "High"), (10, 109): (990.0, "High"), (10, 200): (1900.0, "nan"), (0, 5): (None, "nan"),
        (0, 0): (None, "nan"), (100, 90): (-10.0, "Low"),
    }
    got = spend.analyze_costs(costs(spark, *cases)).collect()
    assert [(r.variance_pct, r.risk_level) for r in got] == list(cases.values())


def test_savings(spark):
    got = spend.analyze_costs(costs(spark, (0, 10), (0, 30), (30, 0))).collect()
    # 4.5 and 13.5 round to even.
    assert [r.savings_opportunity for r in got] == [4.0, 14.0, 0.0]


def test_missing_amounts_stay_missing(spark):
    frame = spark.createDataFrame([("2026-13-01", None, 5.0)], "date string, actual_amount double, budget_amount double")
    row = spend.analyze_costs(frame, unbanded="Unknown").first()
    assert (row.date, row.variance, row.savings_opportunity, row.risk_level) == (None, None, None, "Unknown")


def test_rollups(spark):
    rows = [
        ROW, ROW[:3] + ("Vendor B", 100, 400) + ROW[6:], ("2026-02-01", "HR") + ROW[2:4] + (50, 20) + ROW[6:],
        (ROW[0], "Ops") + ROW[2:],
    ]
    analyzed = spend.analyze_costs(inline_costs(spark, rows))
    totals = spend.cost_totals(analyzed).first()
    assert (totals.total_spend, totals.total_budget, totals.variance, totals.savings) == (640, 350, 290, 4 + 135 + 4)
    shares = [(r.vendor, r.share) for r in spend.vendor_share(analyzed).collect()]
    assert shares == [("Vendor B", 0.625), ("Vendor A", 0.375)]
    rolled = spend.cost_rollup(analyzed, "department", "vendor")
    for frame in (analyzed, rolled):
        summary = spend.cost_summary(frame).first()
        assert (summary.top_department, summary.top_vendor, summary.total_spend) == ("IT", "Vendor B", 640)
    assert "$640" in spend.cost_report(rolled).first().report
    assert [r.department for r in spend.cost_by_department(analyzed).collect()] == ["HR", "IT", "Ops"]
    assert [r.actual_amount for r in spend.cost_by_date(analyzed).collect()] == [620, 20]


def test_leader_ties_go_to_the_smaller_name(spark):
    analyzed = spend.analyze_costs(inline_costs(spark, [ROW[:1] + ("Zeta",) + ROW[2:], ROW[:1] + ("Alpha",) + ROW[2:]]))
    assert spend.cost_summary(analyzed).first().top_department == "Alpha"


def test_vendor_share_needs_no_single_partition_window(spark):
    plan = spend.vendor_share(spend.analyze_costs(inline_costs(spark, [ROW])))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_empty_costs(spark):
    analyzed = spend.analyze_costs(inline_costs(spark, [ROW]).limit(0))
    assert spend.cost_totals(analyzed).first().total_spend == 0
    assert "N/A" in spend.cost_report(analyzed).first().report


def test_roi(spark):
    row = spend.roi(spark.createDataFrame([(50000,)], "cost bigint"), "cost").first()
    assert (row.monthly_savings, row.labor_savings, row.total_value) == (4000.0, 700.0, 4700.0)
