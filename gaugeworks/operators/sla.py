"""SLA status per ticket and SLA summaries."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.functions.dates import hours_between, literal_time, parse_time
from gaugeworks.operators.measures import average, rate, summarise, total


def prepare_dates(frame: DataFrame, lenient: bool = False, formats: tuple[str, ...] = ()) -> DataFrame:
    """Parse the three times (bad created/due times raise unless `lenient`; closed_at never raises) and add hours."""
    frame = frame.withColumns(
        {
            "created_at": parse_time(F.col("created_at"), lenient, formats),
            "sla_due_at": parse_time(F.col("sla_due_at"), lenient, formats),
            "closed_at": parse_time(F.col("closed_at"), True, formats),
        }
    )
    return frame.withColumn("actual_resolution_hours", hours_between(F.col("created_at"), F.col("closed_at")))


def add_sla(
    frame: DataFrame, as_of: datetime = C.AS_OF, at_risk_hours: float | None = None, lenient: bool = False,
    formats: tuple[str, ...] = (),
) -> DataFrame:
    """Add hours, sla_status and sla_breached. Times are ISO text or of one of the `formats`.

    Open tickets are judged at `as_of`. `at_risk_hours` marks open tickets due within that time as `At Risk`; off by
    default, then that status does not occur. A ticket without a due time is never breached.
    """
    frame = prepare_dates(frame, lenient, formats)
    due, closed, now = F.col("sla_due_at"), F.col("closed_at"), literal_time(as_of)
    status = F.when(closed.isNotNull(), F.when(closed > due, "Breached").otherwise("Met")).when(now > due, "Breached")
    if at_risk_hours is not None:
        status = status.when(hours_between(now, due) <= at_risk_hours, "At Risk")
    return frame.withColumn("sla_status", status.otherwise("Open - On Track")).withColumn(
        "sla_breached", F.col("sla_status") == "Breached"
    )


def sla_summary(frame: DataFrame, by: str = "department", ordered: bool = True) -> DataFrame:
    """Tickets, breach rate and average hours per group, worst first. Takes a frame with SLA columns or a rollup."""
    found = summarise(
        frame,
        [by],
        total_tickets=total("ids"),
        sla_breach_rate=rate("breached", "rows"),
        avg_resolution_hours=average("hours", "hours_n"),
    )
    return found.orderBy(F.desc("sla_breach_rate"), by) if ordered else found
