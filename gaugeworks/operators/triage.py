"""Rule-based triage of every ticket: one row-local projection over the scored table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.functions.sentiment import is_negative
from gaugeworks.functions.text import fill, join, present

FIELDS = C.TRIAGE_FIELDS


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def _number(name: str, default: int) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(default))


def _score() -> Column:
    return _number("escalation_risk_score", 0)


def _level() -> Column:
    return F.col("action_level")


def action_level() -> Column:
    """The first rule that holds, from the strictest to the default."""
    urgent = (
        (_text("sla_status") == "Breached")
        & is_negative(F.col("sentiment"))
        & _text("priority").isin("High", "Critical")
    )
    critical, review, monitor, normal = C.ACTION_LEVELS
    return (
        F.when((_score() >= C.CRITICAL_SCORE) | urgent, critical)
        .when(_score() >= C.REVIEW_SCORE, review)
        .when(_score() >= C.MONITOR_SCORE, monitor)
        .otherwise(normal)
    )


def per_level(texts, **slots: Column) -> Column:
    """The text that belongs to the row's action level."""
    chain = F
    for level, text in zip(C.ACTION_LEVELS[:-1], texts):
        chain = chain.when(_level() == level, fill(text, **slots))
    return chain.otherwise(fill(texts[-1], **slots))


def business_impact() -> Column:
    upset = is_negative(F.col("sentiment")) & (_number("customer_rating", 3) <= C.LOW_RATING)
    churn, escalation, moderate, low = C.IMPACTS
    return (
        F.when((_score() >= C.CRITICAL_SCORE) | upset, churn)
        .when((_text("status") == "Escalated") | (_score() >= C.REVIEW_SCORE), escalation)
        .when(_score() >= C.MONITOR_SCORE, moderate)
        .otherwise(low)
    )


def risk_factors() -> Column:
    """Array of the factors that hold, in a fixed order."""
    line, sla = C.RISK_FACTORS, _text("sla_status")
    contacts, rating = _number("previous_contacts", 0), _number("customer_rating", 3)
    return present(
        (_text("priority").isin("High", "Critical"), fill(line["priority"], priority=F.col("priority"))),
        (sla == "Breached", F.lit(line["breached"])),
        (sla == "At Risk", F.lit(line["at_risk"])),
        (is_negative(F.col("sentiment")), fill(line["sentiment"], sentiment=F.lower("sentiment"))),
        (contacts >= C.MANY_CONTACTS, fill(line["contacts"], contacts=contacts)),
        (rating <= C.LOW_RATING, fill(line["rating"], rating=rating)),
        (_text("status") == "Escalated", F.lit(line["escalated"])),
        (_score() >= C.CRITICAL_SCORE, F.lit(line["score"])),
    )


def or_no_factor(found: Column) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(C.RISK_FACTORS["none"])))


def customer_reply() -> Column:
    issue = F.lower(_text("issue_type", "request"))
    return (
        F.when(_level().isin(*C.ACTION_LEVELS[:2]), fill(W.REPLY_URGENT, issue=issue))
        .when(is_negative(F.col("sentiment")), fill(W.REPLY_UPSET, issue=issue))
        .when(_text("sla_status") == "At Risk", fill(W.REPLY_DUE_SOON, issue=issue))
        .otherwise(fill(W.REPLY_STANDARD, issue=issue))
    )


def manager_note() -> Column:
    return fill(
        W.MANAGER_NOTE,
        ticket_id=_text("ticket_id", "Unknown"),
        level=_level(),
        department=_text("department", "Support"),
        issue=_text("issue_type", "Unknown"),
        score=_score(),
        factors=join(F.col("risk_factors"), "; "),
    )


def trace() -> Column:
    slots = dict(
        ticket_id=_text("ticket_id", "Unknown"),
        sla_status=_text("sla_status", "Unknown"),
        sentiment=_text("sentiment", "Unknown"),
        contacts=_number("previous_contacts", 0),
        score=_score(),
        level=_level(),
    )
    return F.array(*[fill(line, **slots) for line in (*W.TRACE, W.TRACE_RULES)])


def with_triage(scored: DataFrame) -> DataFrame:
    """The scored table with a struct column `triage` of the 15 fields."""
    department = _text("department", "Support")
    # Level and factors feed other fields, so they are projected first and computed once.
    staged = scored.withColumns({"action_level": action_level(), "_found": risk_factors()})
    staged = staged.withColumn("risk_factors", or_no_factor(F.col("_found"))).drop("_found")
    made = {
        "ticket_id": F.col("ticket_id"),
        "risk_score": _score(),
        "risk_level": _text("risk_level", "Unknown"),
        "sla_status": _text("sla_status", "Unknown"),
        "sentiment": _text("sentiment", "Unknown"),
        "action_level": _level(),
        "recommended_action": per_level(W.ACTIONS, department=department),
        "routing_recommendation": per_level(W.ROUTES, department=department),
        "urgency": per_level(C.URGENCIES),
        "business_reason": per_level(W.REASONS),
        "business_impact": business_impact(),
        "risk_factors": F.col("risk_factors"),
        "internal_manager_note": manager_note(),
        "customer_response_draft": customer_reply(),
        "agent_trace": trace(),
    }
    return staged.withColumn("triage", F.struct(*[made[f].alias(f) for f in FIELDS])).drop(
        "action_level", "risk_factors"
    )


def triage(scored: DataFrame) -> DataFrame:
    """The 15-field triage record of every ticket. For one ticket, filter the scored table first."""
    return with_triage(scored).select("triage.*")


def triage_prompts(scored: DataFrame) -> DataFrame:
    """(ticket_id, prompt): the ticket and its triage as JSON, with the instructions."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    keys = ", ".join(f for f in FIELDS if f != "ticket_id")
    prompt = fill(
        W.TRIAGE_PROMPT,
        keys=F.lit(keys),
        ticket=F.to_json(F.struct(*scored.columns), options),
        baseline=F.to_json("triage", options),
    )
    return with_triage(scored).select("ticket_id", prompt.alias("prompt"))
