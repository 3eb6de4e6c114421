from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.operators import briefing, questions, risk


def sample(tickets):
    return tickets(
        *[dict(agent="Ava", priority="Critical", customer_message="tired of waiting", status="Escalated") for _ in range(3)],
        dict(agent="Noah", department="Shipping", issue_type="Late Delivery", closed_at="x" and None,
             sla_due_at=C.AS_OF, customer_message="thanks"),
    )


def test_briefing_record(tickets):
    brief = briefing.briefing(risk.add_risk(sample(tickets)), tickets=2).first()
    assert brief.kpis.total_tickets == 4 and brief.kpis.sla_breach_rate == 75.0
    assert brief.briefing_sections.sla_risk == W.BRIEF_SLA.format(department="Billing", rate="100.0", breached="3")
    assert brief.recommended_actions == [
        W.ACTION_BREACHES, W.ACTION_HIGH_RISK.format(n=3), W.ACTION_NEGATIVE, W.ACTION_OVERLOAD,
        W.ACTION_ISSUE.format(issue="Refund Delay"),
    ]
    assert [t.ticket_id for t in brief.top_high_risk_tickets] == ["T1", "T2"]
    assert [p.department for p in brief.top_pain_points] == ["Billing", "Shipping"]
    assert brief.overloaded_agents == 1


def test_calm_briefing_has_one_action(tickets):
    calm = tickets(dict(sla_due_at=C.AS_OF, customer_message="thanks"))
    brief = briefing.briefing(risk.add_risk(calm)).first()
    assert brief.recommended_actions == [W.ACTION_ISSUE.format(issue="Refund Delay")]


def test_briefing_text(tickets):
    brief = briefing.briefing(risk.add_risk(sample(tickets)))
    text = briefing.briefing_report(brief).first().report
    assert text.startswith(W.BRIEF_HEADING + "\n\n") and "\n1. " + W.ACTION_BREACHES in text
    prompt = briefing.briefing_prompt(brief).first().prompt
    assert '"total_tickets":4' in prompt


def test_merge_briefing(tickets):
    brief = briefing.briefing(risk.add_risk(sample(tickets)))

    def merged(reply):
        return briefing.merge_briefing(brief, F.lit(reply).cast("string")).first()

    given = merged('{"briefing_sections": {"sla_risk": "Act."}, "recommended_actions": ["x"]}')
    assert (given.briefing_sections.sla_risk, given.recommended_actions, given.mode) == ("Act.", ["x"], "model")
    assert given.briefing_sections.executive_summary.startswith("The queue holds 4")
    assert given.agent_trace[-1] == W.TRACE_REPLY
    broken = merged("{")
    assert broken.mode == "rules" and broken.agent_trace[-1] == W.TRACE_BAD_REPLY
    assert merged(None).agent_trace[-1] == W.TRACE_RULES


def test_findings(tickets):
    found = briefing.run_findings(sample(tickets), "why?")
    record = found.record.first()
    assert (record.status, record.mode, record.user_question) == ("success", "rules", "why?")
    assert W.SCORED_TRACE in record.agent_trace and W.QUESTION_TRACE.format(question="why?") in record.agent_trace
    assert record.findings.kpis.total_tickets == 4 and len(record.findings.top_high_risk_tickets) == 4
    assert record.manager_briefing.startswith(W.MANAGER_HEADING)
    assert [r.department for r in found.sla_by_department.collect()] == ["Billing", "Shipping"]
    assert found.issue_type_summary.count() == 2 and found.overloaded_agents.first().agent == "Ava"
    again = briefing.run_findings(risk.add_risk(sample(tickets))).record.first()
    assert W.ALREADY_SCORED_TRACE in again.agent_trace


def test_findings_without_tickets(tickets):
    record = briefing.run_findings(tickets()).record.first()
    assert (record.status, record.agent_trace, record.findings) == ("error", [W.NO_TICKETS], None)
    assert (record.manager_briefing, record.recommended_actions) == ("", [])
    assert briefing.recommendations(risk.add_risk(tickets())).isEmpty()


def test_recommendations(tickets):
    got = briefing.recommendations(risk.add_risk(sample(tickets))).collect()
    assert [r.position for r in got] == [1, 2, 3, 4, 5]
    assert got[0].opportunity == W.RECOMMENDATIONS[0][1].format(name="Billing")
    assert got[4].reason == W.RECOMMENDATIONS[4][2].format(value=3, more=3)
    calm = briefing.recommendations(risk.add_risk(tickets(dict(), dict())))
    assert [r.position for r in calm.collect()] == [1, 2, 4, 5]


def test_questions(spark):
    asked = questions.ask(
        spark.createDataFrame([("a", "why " * 200), ("b", "what?")], "question_id string, question string"),
        F.lit("all is well"), W.SUPPORT_QUESTION, W.SUPPORT_ANSWER,
    )
    rows = {r.question_id: r for r in asked.collect()}
    assert "why " * 200 in rows["a"].prompt and "all is well" in rows["b"].fallback_answer
    cut = questions.ask(asked.select("question_id", F.col("prompt").alias("question")), F.lit("x"), "{question}{summary}", "{summary}", max_chars=9)
    assert C.TRUNCATION_MARK in cut.first().prompt
    given = spark.createDataFrame([("a", " because \n")], "question_id string, reply string")
    answers = {r.question_id: r.answer for r in questions.answer(asked, given).collect()}
    assert answers == {"a": "because", "b": rows["b"].fallback_answer}


def test_no_job_runs_while_a_briefing_is_built(spark, tickets):
    scored = risk.add_risk(tickets(dict(), dict()))
    spark.sparkContext.setJobGroup("building", "none expected")
    try:
        briefing.briefing(scored)
        briefing.run_findings(scored)
        briefing.recommendations(scored)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
