"""KPIs and summaries of scored tickets. Each takes the scored frame or a `measures.rollup` of it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.functions.numeric import percent
from gaugeworks.functions.sentiment import is_negative
from gaugeworks.functions.text import fill
from gaugeworks.operators.cleaning import find_column
from gaugeworks.operators.measures import average, rate, summarise, total


def kpi_columns(of=F.sum) -> dict[str, Column]:
    return dict(
        total_tickets=total("rows", of),
        open_tickets=total("open", of),
        closed_tickets=total("closed", of),
        escalated_tickets=total("escalated", of),
        sla_breach_rate=rate("breached", "rows", of),
        avg_resolution_hours=average("hours", "hours_n", of),
        avg_customer_rating=average("rating", "rating_n", of),
        high_risk_tickets=total("high", of),
        negative_sentiment_rate=rate("negative", "rows", of),
        breached_tickets=total("breached", of),
        negative_tickets=total("negative", of),
    )


def kpis(frame: DataFrame) -> DataFrame:
    """One row with all KPIs and the counters the briefing needs."""
    return summarise(frame, [], **kpi_columns())


def agent_performance(frame: DataFrame, ordered: bool = True) -> DataFrame:
    found = summarise(
        frame,
        ["agent"],
        total_tickets=total("ids"),
        avg_resolution_hours=average("hours", "hours_n"),
        sla_breach_rate=rate("breached", "rows"),
        avg_customer_rating=average("rating", "rating_n"),
        high_risk_tickets=total("high"),
    )
    return found.orderBy(F.desc("total_tickets"), "agent") if ordered else found


def issue_summary(frame: DataFrame, ordered: bool = True) -> DataFrame:
    found = summarise(
        frame,
        ["issue_type"],
        total_tickets=total("ids"),
        sla_breach_rate=rate("breached", "rows"),
        avg_risk_score=average("score", "rows"),
        avg_customer_rating=average("rating", "rating_n"),
    )
    return found.orderBy(F.desc("total_tickets"), "issue_type") if ordered else found


def cause_columns(of=F.sum) -> dict[str, Column]:
    return dict(
        total_tickets=total("ids", of),
        sla_breaches=total("breached", of),
        high_risk_tickets=total("high", of),
        avg_risk_score=average("score", "rows", of),
        avg_customer_rating=average("rating", "rating_n", of),
    )


def root_causes(frame: DataFrame, ordered: bool = True) -> DataFrame:
    """Per department and issue, most high-risk tickets first, then most breaches."""
    found = summarise(frame, ["department", "issue_type"], **cause_columns())
    order = [F.desc("high_risk_tickets"), F.desc("sla_breaches"), "department", "issue_type"]
    return found.orderBy(*order) if ordered else found


def top_pain_points(frame: DataFrame, n: int = 10) -> DataFrame:
    return root_causes(frame).limit(n)


def risk_histogram(frame: DataFrame) -> DataFrame:
    return summarise(frame, ["risk_level"], count=total("rows")).orderBy(F.desc("count"), "risk_level")


def overloaded_agents(agents: DataFrame) -> DataFrame:
    """Agents of an `agent_performance` frame above the mean in tickets or in high-risk tickets, and why.

    The means come in as a one-row subquery over the same frame, whose shuffle the two share.
    """
    mean = agents.agg(F.avg("total_tickets").alias("tickets"), F.avg("high_risk_tickets").alias("high"))
    compared = agents.withColumn("_mean", mean.select(F.struct("tickets", "high")).scalar())
    many = F.col("total_tickets") > F.col("_mean.tickets")
    risky = F.col("high_risk_tickets") > F.col("_mean.high")
    both, volume, high_risk = C.WORKLOAD_REASONS
    reason = F.when(many & risky, both).when(many, volume).when(risky, high_risk)
    return (
        compared.withColumn("workload_reason", reason)
        .drop("_mean")
        .where(F.col("workload_reason").isNotNull())
        .orderBy(F.desc("high_risk_tickets"), F.desc("total_tickets"), "agent")
    )


def first_by(frame: DataFrame, *order: Column, take: list[str]) -> Column:
    """Struct of `take` from the row that comes first in `order`: a combinable minimum, not a sort. Null if empty."""
    return frame.agg(F.min_by(F.struct(*take), F.struct(*order))).scalar()


def dataset_summary(frame: DataFrame, template: str) -> DataFrame:
    """One row: tickets, breach rate (1 decimal), busiest department, and the sentence made of them.

    The SLA and department columns are found by their names, as a frame from elsewhere may call them differently.
    """
    breached, department = find_column(frame, "sla", "breach"), find_column(frame, "department")
    unknown, nothing = F.lit("N/A"), F.lit(None).cast("boolean")
    flags = frame.select(
        (F.col(department).cast("string") if department else F.lit(None).cast("string")).alias("name"),
        (F.col(breached).cast("boolean") if breached else nothing).alias("late"),
    )
    # Counted per department once; totals and the leader are aggregates of those counts.
    counted = flags.groupBy("name").agg(
        F.count("*").alias("n"), F.count("late").alias("known"), F.count_if("late").alias("late")
    )
    summary = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_tickets"),
        percent(F.sum("late"), F.sum("known"), 1).alias("sla_breach_rate"),
        F.coalesce(F.min_by("name", F.struct(F.col("name").isNull(), -F.col("n"), F.col("name"))), unknown).alias(
            "top_department"
        ),
    )
    return summary.withColumn(
        "summary",
        fill(
            template,
            tickets=F.col("total_tickets"),
            rate=F.coalesce(F.col("sla_breach_rate").cast("string"), unknown),
            department=F.col("top_department"),
        ),
    )


def customers_to_contact(scored: DataFrame) -> DataFrame:
    """Customers with a negative ticket, those with a breached one first."""
    negative = is_negative(F.col("sentiment"))
    # Counted first, filtered after: a filter on the label would be pushed below it and evaluate the word lists again.
    counted = scored.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count_if(negative).alias("negative_tickets"),
        F.count_if(negative & F.col("sla_breached")).alias("breached_negative_tickets"),
        F.max(F.when(negative, F.col("escalation_risk_score"))).alias("highest_risk_score"),
    )
    return counted.where("negative_tickets > 0").orderBy(
        F.desc(F.col("breached_negative_tickets") > 0), F.desc("highest_risk_score"), "customer_id"
    )
