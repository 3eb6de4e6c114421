import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.operators import replies, risk, triage

BASE = dict(
    ticket_id="T1", department="Billing", issue_type="Refund Delay", priority="Low", status="Open", sla_status="Met",
    sentiment="Neutral", previous_contacts=0, customer_rating=4, escalation_risk_score=10, risk_level="Low",
    customer_id="C", created_at="2025-01-01", agent="Ava", customer_message="hi",
)
SCHEMA = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in BASE.items())


@pytest.fixture
def triaged(spark):
    def make(*changes):
        rows = [tuple({**BASE, "ticket_id": f"T{i}", **c}.values()) for i, c in enumerate(changes, start=1)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def records(frame):
    return [r.asDict() for r in triage.triage(frame).orderBy("ticket_id").collect()]


def test_action_levels(triaged):
    urgent = dict(sla_status="Breached", sentiment="Negative", priority="High")
    got = records(
        triaged(
            dict(escalation_risk_score=85), dict(escalation_risk_score=84), dict(escalation_risk_score=70),
            dict(escalation_risk_score=69), dict(escalation_risk_score=50), dict(escalation_risk_score=49),
            urgent, dict(urgent, priority="Medium"), dict(urgent, sentiment="Neutral"),
        )
    )
    critical, review, monitor, normal = C.ACTION_LEVELS
    assert [r["action_level"] for r in got] == [
        critical, review, review, monitor, monitor, normal, critical, normal, normal,
    ]
    assert [r["urgency"] for r in got[:6]] == ["Immediate", "High", "High", "Medium", "Medium", "Normal"]
    assert got[0]["recommended_action"] == W.ACTIONS[0].format(department="Billing")
    assert got[4]["routing_recommendation"] == W.ROUTES[2]


def test_business_impact(triaged):
    got = records(
        triaged(
            dict(escalation_risk_score=85), dict(customer_rating=2, sentiment="Very Negative"),
            dict(customer_rating=None, sentiment="Negative"), dict(status="Escalated"), dict(escalation_risk_score=70),
            dict(escalation_risk_score=50), dict(),
        )
    )
    churn, escalation, moderate, low = C.IMPACTS
    assert [r["business_impact"] for r in got] == [churn, churn, low, escalation, escalation, moderate, low]


def test_risk_factors(triaged):
    got = records(
        triaged(
            dict(priority="Critical", sla_status="Breached", sentiment="Very Negative", previous_contacts=3,
                 customer_rating=1, status="Escalated", escalation_risk_score=90),
            dict(sla_status="At Risk"), dict(customer_rating=None, previous_contacts=2),
        )
    )
    assert got[0]["risk_factors"] == [
        "Critical priority ticket", "SLA is already breached", "Customer sentiment is very negative",
        "Customer has contacted support 3 times", "Low customer rating: 1/5", "Ticket is already escalated",
        "Overall escalation risk score is very high",
    ]
    assert got[1]["risk_factors"] == ["Ticket is close to SLA breach"]
    assert got[2]["risk_factors"] == [C.RISK_FACTORS["none"]]
    assert "; ".join(got[0]["risk_factors"]) in got[0]["internal_manager_note"]


def test_reply_drafts(triaged):
    got = records(
        triaged(dict(escalation_risk_score=70), dict(sentiment="Negative"), dict(sla_status="At Risk"), dict(issue_type=None))
    )
    templates = (W.REPLY_URGENT, W.REPLY_UPSET, W.REPLY_DUE_SOON)
    assert [r["customer_response_draft"] for r in got[:3]] == [t.format(issue="refund delay") for t in templates]
    assert got[3]["customer_response_draft"] == W.REPLY_STANDARD.format(issue="request")


def test_missing_values_have_defaults(spark, triaged):
    nothing = {k: None for k in BASE if k not in ("created_at",)}
    got, = triage.triage(triaged(nothing)).collect()
    assert (got.risk_score, got.risk_level, got.sla_status, got.sentiment) == (0, "Unknown", "Unknown", "Unknown")
    assert got.action_level == "Normal Queue" and len(got.agent_trace) == 9


def test_triage_has_no_shuffle(triaged):
    plan = triage.triage(triaged(dict()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_prompt_holds_ticket_and_baseline(triaged):
    prompt = triage.triage_prompts(triaged(dict(customer_message=None))).first().prompt
    ticket, baseline = prompt.split("Ticket:\n")[1].split("\n\nRule-based result:\n")
    assert json.loads(ticket)["customer_message"] is None
    assert json.loads(baseline)["action_level"] == "Normal Queue"


def merged(spark, triaged, *given):
    rows = [(f"T{i}", reply) for i, reply in enumerate(given, start=1)]
    table = spark.createDataFrame(rows, "ticket_id string, reply string")
    frame = triaged(*[dict() for _ in given])
    return [r.asDict() for r in replies.merge_triage(frame, table).orderBy("ticket_id").collect()]


def test_merge(spark, triaged):
    got = merged(
        spark, triaged,
        '```json\n{"risk_score": "91", "risk_factors": ["a"], "agent_trace": ["read"], "urgency": null}\n```',
        '{"risk_score": "much"}', '{"risk_score": 40.9, "risk_factors": "none", "sentiment": "Angry"}', "no", "", None,
    )
    assert [r["mode"] for r in got] == ["model", "rules", "model", "rules", "rules", "rules"]
    assert [r["risk_score"] for r in got] == [91, 10, 40, 10, 10, 10]
    assert got[0]["risk_factors"] == ["a"] and got[0]["urgency"] == "Normal"
    assert got[0]["agent_trace"] == ["read", W.TRACE_REPLY]
    assert got[2]["sentiment"] == "Angry" and got[2]["risk_factors"] == [C.RISK_FACTORS["none"]]
    assert got[1]["agent_trace"][-1] == got[3]["agent_trace"][-1] == W.TRACE_BAD_REPLY
    assert got[4]["agent_trace"][-1] == got[5]["agent_trace"][-1] == W.TRACE_RULES


def test_merge_neither_drops_nor_multiplies_tickets(spark, triaged):
    frame = triaged(dict(ticket_id="x"), dict(ticket_id="x", agent="Noah"), dict(ticket_id=None), dict(ticket_id="y"))
    table = spark.createDataFrame(
        [("x", "{}"), ("x", None), ("x", "no"), (None, "{}"), ("z", "{}")], "ticket_id string, reply string"
    )
    got = replies.merge_triage(frame, table).collect()
    assert sorted(str(r.ticket_id) for r in got) == ["None", "x", "x", "y"]


def test_complete_runs_the_callers_function(spark, triaged):
    prompts = triage.triage_prompts(triaged(dict(), dict()))

    def answer(batch):
        return ['{"risk_score": %d}' % len(prompt) for prompt in batch]

    got = replies.complete(prompts, "ticket_id", answer)
    assert got.columns == ["ticket_id", "reply"]
    want = {r.ticket_id: len(r.prompt) for r in prompts.collect()}
    assert {r.ticket_id: r.risk_score for r in replies.parsed_replies(got).collect()} == want


def test_feedback_validation(spark):
    fallback = {name: F.array(F.lit(f"{name} default")) for name in replies.FEEDBACK_FIELDS}
    fallback["overall_feedback"] = F.lit("default")
    given = [
        '{"overall_feedback": "  %s ", "strengths": ["a", " ", "b"], "gaps": "none", "agent_trace": []}' % ("y" * 1300),
        '{"overall_feedback": "", "strengths": null, "interview_questions": [1, 2]}',
        "nothing",
    ]
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, reply string")
    first, second, third = [r.parsed for r in replies.with_feedback_reply(frame, fallback).orderBy("i").collect()]
    assert first.overall_feedback == "y" * 1200
    assert (first.strengths, first.gaps, first.agent_trace) == (["a", "b"], [], ["agent_trace default"])
    assert first.resume_improvements == ["resume_improvements default"]
    assert (second.overall_feedback, second.strengths, second.interview_questions) == ("default", [], ["1", "2"])
    assert third is None


def test_triage_of_one_ticket(tickets):
    scored = risk.add_risk(tickets(dict(), dict(priority="Critical")))
    row, = triage.triage(scored.where("ticket_id = 'T2'")).collect()
    assert (row.ticket_id, row.risk_score) == ("T2", 35 + 5 + 25)
