"""Table schemas. Timestamps carry no zone; money is decimal."""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_text, _time, _int = T.StringType(), T.TimestampNTZType(), T.IntegerType()
_money = T.DecimalType(18, 2)

TICKETS = _schema(
    ticket_id=_text, customer_id=_text, department=_text, issue_type=_text, priority=_text, agent=_text,
    channel=_text, created_at=_time, sla_due_at=_time, closed_at=_time, status=_text,
    resolution_hours=T.DoubleType(), previous_contacts=_int, customer_message=_text, customer_rating=_int,
)
COSTS = _schema(
    date=T.DateType(), department=_text, cost_category=_text, vendor=_text, budget_amount=_money,
    actual_amount=_money, project_name=_text, region=_text, owner=_text, business_unit=_text,
)
