from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeworks import schemas, session
from gaugeworks.operators import risk, spend
from gaugeworks.sources import sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_csv_roundtrip(spark, tickets, tmp_path):
    path = str(tmp_path / "tickets.csv")
    frame = tickets(
        dict(customer_message='says "no", then, leaves', resolution_hours=2.5, created_at=datetime(2025, 1, 1, 1, 2, 3, 4000)),
        dict(customer_message="NA"), dict(customer_rating=None),
    )
    sinks.write_csv(frame, path)
    read = tables.cast_to(tables.load_tickets(spark, path, label="demo"), schemas.TICKETS)
    want = frame.withColumn("customer_message", F.nullif("customer_message", F.lit("NA"))).withColumn("source", F.lit("demo"))
    assert sorted(map(str, read.collect())) == sorted(map(str, want.collect()))


def test_csv_missing_tokens_and_names(spark, tmp_path):
    path = write(tmp_path / "t.csv", " ticket_id ,status,note\nT1,NA,\nT2,null,none\nT3,Open,#N/A\n")
    rows = tables.read_csv(spark, path).orderBy("ticket_id").collect()
    assert [tuple(r) for r in rows] == [("T1", None, None), ("T2", None, "none"), ("T3", "Open", None)]


def test_csv_with_line_breaks(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'ticket_id,note\nT1,"two\nlines"\n')
    assert tables.read_csv(spark, path, multiline=True).first().note == "two\nlines"


def test_guarded_csv(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b\n1,2\n3,4\n")
    assert tables.read_guarded_csv(spark, path).count() == 2
    assert tables.read_guarded_csv(spark, path, max_rows=2).count() == 2
    for limit in (dict(max_rows=1), dict(max_bytes=5), dict(max_columns=1)):
        with pytest.raises(tables.UploadRejected):
            tables.read_guarded_csv(spark, path, **limit)


def test_load_by_kind(spark, tickets, tmp_path):
    frame = tickets(dict(), dict())
    sinks.write_table(frame, str(tmp_path / "t.parquet"))
    assert tables.load_tickets(spark, str(tmp_path / "t.parquet")).count() == 2
    table = tables.register_tickets(frame.drop("resolution_hours"))
    assert table.schema == schemas.TICKETS
    assert tables.load(spark, "support_tickets").count() == 2


def test_load_costs(spark, tmp_path):
    path = write(tmp_path / "c.csv", "date,department,cost_category,vendor,budget_amount,actual_amount\n2026-01-01,IT,Cloud,A,10,12.5\nsoon,IT,Cloud,A,x,1\n")
    good, bad = spend.analyze_costs(tables.load_costs(spark, path)).collect()
    assert (good.variance_pct, good.risk_level) == (25.0, "High")
    assert (bad.date, bad.budget_amount, bad.risk_level) == (None, None, "nan")


def test_load_texts(spark, tmp_path):
    path = write(tmp_path / "x.csv", "id,body\n1,hello\n2,  \n3,\n")
    assert [tuple(r) for r in tables.load_texts(spark, path, "id", "body").collect()] == [("1", "hello")]


def test_text_sink(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([("a\n\nb",)], "report string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["a", "", "b"]


def test_cleaned_csv_can_be_scored(spark, tmp_path):
    from gaugeworks.operators.cleaning import clean_tickets, require_columns

    path = write(
        tmp_path / "t.csv",
        "ticket_id,customer_id,department,issue_type,priority,agent,channel,created_at,sla_due_at,closed_at,status,"
        "previous_contacts,customer_message,customer_rating\n"
        "T1,C1,Billing,Refund, High ,Ava,Email,2025-01-01,2025-01-02,,Open,2.0,I am tired,\n",
    )
    row = risk.add_risk(require_columns(clean_tickets(tables.read_csv(spark, path)))).first()
    assert (row.escalation_risk_score, row.risk_level, row.customer_rating) == (25 + 15 + 25 + 10, "High", 3)


def test_materialized_frames_come_from_the_shared_folder(spark):
    frame = session.materialize(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count())
    assert "ExistingRDD" in frame._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in frame.collect()} == {(0, 5), (1, 5)}
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark).rstrip("/"))


def test_qualified_table_names(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("default.numbers_for_load")
    try:
        assert tables.load(spark, "default.numbers_for_load").count() == 3
        assert tables.load(spark, "numbers_for_load").count() == 3
    finally:
        spark.sql("DROP TABLE default.numbers_for_load")


def test_declared_columns_check_every_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert tables.read_csv(spark, str(tmp_path), columns=["x", "y"]).collect()[0].asDict() == {"x": "1", "y": "2"}
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(tmp_path), columns=["x", "y"]).collect()


def test_strict_costs_and_rejected_cells(spark, tmp_path):
    path = tmp_path / "costs.csv"
    path.write_text("date,department,actual_amount\n01/31/2025,IT,10.50\n2025-02-01,HR,1.005\nsoon,HR,much\n")
    raw = tables.load(spark, str(path))
    formats = ("MM/dd/yyyy",)
    assert tables.rejected_cells(raw, schemas.COSTS, formats).first().asDict() == {"date": 1, "department": 0, "actual_amount": 2}
    costs = tables.load_costs(spark, str(path), formats=formats)
    assert [str(r.date) for r in costs.collect()] == ["2025-01-31", "2025-02-01", "None"]
    with pytest.raises(Exception):
        tables.load_costs(spark, str(path), lenient=False, formats=formats).collect()
    path.write_text("date,department,actual_amount\n01/31/2025,IT,10.50\n")
    assert str(tables.load_costs(spark, str(path), lenient=False, formats=formats).first().actual_amount) == "10.50"


def test_scratch_goes_when_its_owner_says_so(spark):
    path = session.scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    session.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
