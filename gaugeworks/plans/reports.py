"""Plain SQL reports over a ticket table. They read stored columns only: open overdue tickets do not count as late."""

from pyspark.sql import DataFrame


def breach_rate_by_department(tickets: DataFrame) -> DataFrame:
    return tickets.sparkSession.sql(
        """
        SELECT department, count(*) AS total_tickets,
               count_if(closed_at > sla_due_at) * CAST(100 AS DOUBLE) / count(*) AS sla_breach_rate
        FROM {tickets} GROUP BY department ORDER BY sla_breach_rate DESC, department
        """,
        tickets=tickets,
    )


def volume_by_issue(tickets: DataFrame) -> DataFrame:
    return tickets.sparkSession.sql(
        """
        SELECT issue_type, count(*) AS total_tickets
        FROM {tickets} GROUP BY issue_type ORDER BY total_tickets DESC, issue_type
        """,
        tickets=tickets,
    )


def workload_by_agent(tickets: DataFrame) -> DataFrame:
    return tickets.sparkSession.sql(
        """
        SELECT agent, count(*) AS total_tickets, avg(resolution_hours) AS avg_resolution_hours
        FROM {tickets} GROUP BY agent ORDER BY total_tickets DESC, agent
        """,
        tickets=tickets,
    )
