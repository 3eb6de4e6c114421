"""Briefing, findings and recommendations.

Everything but the lists of single tickets follows in one pass from a rollup of the tickets by department, issue and
agent. Nothing is written and no job runs while a frame is being built. Lists inside a record are top-n lists; lists that grow with the data (departments, issues, overloaded agents) are frames of their own.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.functions.replies import as_list, no_items, parse_object
from gaugeworks.functions.text import fill, lines, numbered, present, whole_number
from gaugeworks.operators import support
from gaugeworks.operators.measures import PREFIX, rate, rollup, total
from gaugeworks.operators.risk import TOP_COLUMNS, ensure_scored, is_scored
from gaugeworks.operators.sla import sla_summary

SECTIONS = tuple(W.BRIEF_TITLES)
KPIS = C.KPIS


def briefing_base(scored: DataFrame) -> DataFrame:
    """The rollup that all parts of a briefing follow from."""
    return rollup(scored, "department", "issue_type", "agent")


def records(frame: DataFrame, order: list[tuple[str, bool]], n: int, take: str | None = None) -> Column:
    """The first n rows of a frame as an array of structs, or their column `take`. `order` lists (column, descending) of numeric or text keys.

    n bounds the rows that are collected into the array.
    """
    ranked = frame.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(n)
    keys = [(-F.col(c) if down else F.col(c)).alias(f"k{i}") for i, (c, down) in enumerate(order)]
    item = F.struct(*keys, (F.col(take) if take else F.struct(*frame.columns)).alias("item"))
    sorted_items = F.sort_array(F.collect_list(item))
    return ranked.agg(F.transform(sorted_items, lambda x: x["item"])).scalar()


def overloaded(base: DataFrame) -> DataFrame:
    return support.overloaded_agents(support.agent_performance(base, ordered=False))


def _or(value: Column, default: str = "N/A") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


# Grouping ids over (department, issue_type, agent): a set bit is a key that is summed over.
ALL, BY_DEPARTMENT, BY_ISSUE, BY_AGENT, BY_CAUSE = 7, 3, 5, 6, 1


def facts(base: DataFrame, pain_points: int = 5) -> DataFrame:
    """One row: the KPIs, the leaders, how many agents are overloaded, and the first `pain_points` root causes.

    One pass over the rollup: grouping sets sum it to all levels, and one aggregate with a condition per level takes what is
    asked. The agents' means are sums of additive totals, and the first causes are a top-n of which each task keeps its own
    n best; both come in as one-row subqueries over the same sums. So no level is ever gathered in one task.
    """
    keys = ("department", "issue_type", "agent")
    measures = [c for c in base.columns if c.startswith(PREFIX)]
    sets = [[], ["department"], ["issue_type"], ["agent"], ["department", "issue_type"]]
    levels = base.groupingSets(sets, *keys).agg(F.grouping_id().alias("_level"), *[F.sum(c).alias(c) for c in measures])
    level, tickets, high, breaches = F.col("_level"), total("ids", F.col), total("high", F.col), total("breached", F.col)
    named = {
        BY_DEPARTMENT: F.col("department").isNotNull(),
        BY_ISSUE: F.col("issue_type").isNotNull(),
        BY_AGENT: F.col("agent").isNotNull(),
        BY_CAUSE: F.col("department").isNotNull() & F.col("issue_type").isNotNull(),
    }
    counted = levels.withColumn("_named", F.coalesce(*[F.when(level == at, present) for at, present in named.items()], F.lit(True)))
    cause_order = [-high, -breaches, F.col("department"), F.col("issue_type")]

    def at(where: int) -> Column:
        return (level == where) & F.col("_named")

    def leader(where: int, order: list[Column], **take: Column) -> Column:
        fields = F.struct(*[c.alias(name) for name, c in take.items()])
        return F.min_by(F.when(at(where), fields), F.when(at(where), F.struct(*order)))

    breach_rate = rate("breached", "rows", F.col)
    cause = F.struct("department", "issue_type", *[c.alias(name) for name, c in support.cause_columns(F.col).items()])
    causes = counted.where(at(BY_CAUSE)).select(high.alias("high"), breaches.alias("breaches"), "department", "issue_type", cause.alias("cause"))
    first_causes = records(causes, [("high", True), ("breaches", True), ("department", False), ("issue_type", False)], pain_points, "cause")
    mean = counted.where(at(BY_AGENT)).agg(F.avg(tickets).alias("tickets"), F.avg(high).alias("high"))
    compared = counted.withColumn("_mean", mean.select(F.struct("tickets", "high")).scalar())
    above = at(BY_AGENT) & ((tickets > F.col("_mean.tickets")) | (high > F.col("_mean.high")))
    row = compared.agg(
        *[F.sum(F.when(level == ALL, F.col(c))).alias(c) for c in measures],
        leader(BY_DEPARTMENT, [-breach_rate, F.col("department")], department=F.col("department"), sla_breach_rate=breach_rate).alias(
            "_department"),
        leader(BY_ISSUE, [-tickets, F.col("issue_type")], issue_type=F.col("issue_type"), total_tickets=tickets).alias("_issue"),
        leader(BY_AGENT, [-tickets, F.col("agent")], agent=F.col("agent"), total_tickets=tickets).alias("_agent"),
        leader(
            BY_CAUSE, cause_order, department=F.col("department"), issue_type=F.col("issue_type"), high_risk_tickets=high,
            sla_breaches=breaches,
        ).alias("_pain_point"),
        F.count_if(above).alias("_overloaded"),
    ).withColumn("_pain_points", first_causes)
    taken = ("_department", "_issue", "_agent", "_pain_point", "_overloaded", "_pain_points")
    return row.select(*[c.alias(name) for name, c in support.kpi_columns(F.col).items()], *taken)


def _sections() -> Column:
    department, issue = F.col("_department"), F.col("_issue")
    negative = whole_number(F.col("negative_tickets"))
    made = {
        "executive_summary": fill(
            W.BRIEF_SUMMARY,
            tickets=whole_number(F.col("total_tickets")),
            rate=_or(F.col("sla_breach_rate")),
            high=whole_number(F.col("high_risk_tickets")),
            negative=negative,
        ),
        "sla_risk": fill(
            W.BRIEF_SLA,
            department=_or(department["department"]),
            rate=_or(department["sla_breach_rate"], "0"),
            breached=whole_number(F.col("breached_tickets")),
        ),
        "customer_sentiment_risk": fill(W.BRIEF_SENTIMENT, negative=negative),
        "top_issue_risk": fill(
            W.BRIEF_ISSUE, issue=_or(issue["issue_type"]), tickets=_or(issue["total_tickets"], "0")
        ),
        "workload_risk": fill(W.BRIEF_WORKLOAD, agents=F.col("_overloaded")),
    }
    return F.struct(*[made[name].alias(name) for name in SECTIONS])


def _actions() -> Column:
    top = F.least(F.lit(10), F.col("high_risk_tickets"))
    return present(
        (F.col("sla_breach_rate") >= C.BREACH_ALERT_RATE, F.lit(W.ACTION_BREACHES)),
        (F.col("high_risk_tickets") > 0, fill(W.ACTION_HIGH_RISK, n=top)),
        (F.col("negative_tickets") > 0, F.lit(W.ACTION_NEGATIVE)),
        (F.col("_overloaded") > 0, F.lit(W.ACTION_OVERLOAD)),
        (F.lit(True), fill(W.ACTION_ISSUE, issue=_or(F.col("_issue")["issue_type"]))),
    )


def briefing(scored: DataFrame, base: DataFrame | None = None, tickets: int = 10, pain_points: int = 5) -> DataFrame:
    """One row: kpis, briefing_sections, recommended_actions, the top lists and agent_trace.

    The overloaded agents are counted here; `overloaded(base)` lists them.
    """
    base = briefing_base(scored) if base is None else base
    return facts(base, pain_points).select(
        F.struct(*KPIS).alias("kpis"),
        _sections().alias("briefing_sections"),
        _actions().alias("recommended_actions"),
        records(
            scored.select(*TOP_COLUMNS), [("escalation_risk_score", True), ("ticket_id", False)], tickets
        ).alias("top_high_risk_tickets"),
        F.col("_pain_points").alias("top_pain_points"),
        F.col("_overloaded").alias("overloaded_agents"),
        F.array(*[F.lit(step) for step in (*W.BRIEF_TRACE, W.TRACE_RULES)]).alias("agent_trace"),
    )


def briefing_prompt(brief: DataFrame) -> DataFrame:
    """One row `prompt` with the KPIs, sections and actions as JSON."""
    payload = F.to_json(
        F.struct(
            "kpis",
            F.col("briefing_sections").alias("baseline_sections"),
            F.col("recommended_actions").alias("baseline_recommended_actions"),
        ),
        {"ignoreNullFields": "false"},
    )
    keys = F.lit("briefing_sections, recommended_actions, agent_trace")
    return brief.select(
        fill(W.BRIEFING_PROMPT, keys=keys, sections=F.lit(", ".join(SECTIONS)), payload=payload).alias("prompt")
    )


def merge_briefing(brief: DataFrame, reply: Column) -> DataFrame:
    """Take over each section, the actions and the trace from a reply where it gives them; adds `mode`."""
    parsed = parse_object(reply, ("briefing_sections", "recommended_actions", "agent_trace"))
    given = F.from_json(parsed["briefing_sections"], ",".join(f"{name} string" for name in SECTIONS))
    sections = F.struct(
        *[F.coalesce(given[name], F.col("briefing_sections")[name]).alias(name) for name in SECTIONS]
    )
    valid = parsed.isNotNull()
    outcome = F.when(valid, W.TRACE_REPLY).when(F.coalesce(reply, F.lit("")) != "", W.TRACE_BAD_REPLY)
    trace = F.coalesce(as_list(parsed["agent_trace"]), F.col("agent_trace"))
    return brief.withColumns(
        {
            "briefing_sections": sections,
            "recommended_actions": F.coalesce(as_list(parsed["recommended_actions"]), F.col("recommended_actions")),
            "agent_trace": F.array_compact(F.array_append(trace, outcome)),
            "mode": F.when(valid, "model").otherwise("rules"),
        }
    )


def briefing_text(brief: DataFrame, heading: str = W.BRIEF_HEADING) -> Column:
    """The briefing as plain text; the findings run uses its own heading."""
    parts = [F.lit(heading)]
    for name, title in W.BRIEF_TITLES.items():
        parts += [F.lit(""), F.lit(f"{title}:"), brief["briefing_sections"][name]]
    parts += [F.lit(""), F.lit(f"{W.ACTIONS_TITLE}:"), numbered(brief["recommended_actions"])]
    return lines(*parts)


def briefing_report(brief: DataFrame) -> DataFrame:
    return brief.select(briefing_text(brief).alias("report"))


@dataclass(frozen=True)
class Findings:
    """Result of a findings run. `record` has one row; the other frames grow with departments, issues and agents."""

    record: DataFrame
    kpis: DataFrame
    sla_by_department: DataFrame
    issue_type_summary: DataFrame
    overloaded_agents: DataFrame


def run_findings(
    tickets: DataFrame, question: str | None = None, as_of: datetime = C.AS_OF, reply: Column | None = None
) -> Findings:
    """Score if needed, summarise and brief. Without tickets the record has status `error`."""
    came_scored = is_scored(tickets)
    scored = ensure_scored(tickets, as_of)
    base = briefing_base(scored)
    brief = merge_briefing(briefing(scored, base, pain_points=10), F.lit(None).cast("string") if reply is None else reply)
    some = F.col("kpis.total_tickets") > 0

    steps = [
        fill(W.FINDINGS_TRACE[0], tickets=whole_number(F.col("kpis.total_tickets"))),
        *([fill(W.QUESTION_TRACE, question=F.lit(question))] if question else []),
        F.lit(W.ALREADY_SCORED_TRACE if came_scored else W.SCORED_TRACE),
        *[F.lit(step) for step in W.FINDINGS_TRACE[1:]],
    ]
    record = brief.select(
        F.when(some, "success").otherwise("error").alias("status"),
        F.col("mode"),
        F.when(some, F.concat(F.array(*steps), F.col("agent_trace")))
        .otherwise(F.array(F.lit(W.NO_TICKETS)))
        .alias("agent_trace"),
        F.when(some, F.struct("kpis", "top_high_risk_tickets", "top_pain_points")).alias("findings"),
        F.lit(question).cast("string").alias("user_question"),
        F.when(some, briefing_text(brief, W.MANAGER_HEADING)).otherwise("").alias("manager_briefing"),
        F.when(some, F.col("recommended_actions")).otherwise(no_items()).alias("recommended_actions"),
    )
    return Findings(
        record,
        support.kpis(base).select(*KPIS),
        sla_summary(base, "department"),
        support.issue_summary(base),
        overloaded(base),
    )


def recommendations(scored: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Up to five rows (position, opportunity, reason, recommendation, impact, difficulty); none without tickets."""
    base = briefing_base(scored) if base is None else base
    found = facts(base).withColumnsRenamed(
        {"_department": "department", "_issue": "issue", "_agent": "agent", "_pain_point": "pain_point"})
    none = F.lit("")
    pain = F.col("pain_point")
    # key: (applies, name, value, more)
    slots = {
        "department": (
            F.col("department").isNotNull(), F.col("department.department"), F.col("department.sla_breach_rate"), none
        ),
        "issue": (F.col("issue").isNotNull(), F.col("issue.issue_type"), F.col("issue.total_tickets"), none),
        "sentiment": (
            F.col("negative_sentiment_rate") > C.NEGATIVE_ALERT_RATE, none, F.col("negative_sentiment_rate"), none
        ),
        "agent": (F.col("agent").isNotNull(), F.col("agent.agent"), F.col("agent.total_tickets"), none),
        "pain_point": (
            pain.isNotNull(),
            F.concat(pain["issue_type"], F.lit(" in "), pain["department"]),
            pain["high_risk_tickets"],
            pain["sla_breaches"],
        ),
    }
    items = []
    for position, (key, opportunity, reason, advice, impact, difficulty) in enumerate(W.RECOMMENDATIONS, start=1):
        applies, name, value, more = slots[key]
        items.append(
            F.when(
                applies,
                F.struct(
                    F.lit(position).alias("position"),
                    fill(opportunity, name=name, value=value, more=more).alias("opportunity"),
                    fill(reason, name=name, value=value, more=more).alias("reason"),
                    F.lit(advice).alias("recommendation"),
                    F.lit(impact).alias("impact"),
                    F.lit(difficulty).alias("difficulty"),
                ),
            )
        )
    listed = found.select(F.inline_outer(F.array_compact(F.array(*items))))
    return listed.where(F.col("position").isNotNull())
