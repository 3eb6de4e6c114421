"""DuckDB SQL for the registered queries, over the same parquet tables.

Logic is written again here in SQL; only the input views, the fixed values and the sentences are shared.
"""

from string import Formatter

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.sources.driver_views import VIEWS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fill(template: str, **slots: str) -> str:
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if slot:
            parts.append(f"CAST({slots[slot]} AS VARCHAR)")
    return "(" + " || ".join(parts or ["''"]) + ")"


def commas(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def half_even(value: str, digits: int) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(round_even(({value}) * {scale}, 0) / {scale})"


def rate(part: str, whole: str, digits: int = 2) -> str:
    return half_even(f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * CAST(100 AS DOUBLE)", digits)


def mean(value: str) -> str:
    return half_even(f"avg(CAST({value} AS DOUBLE))", 2)


def score_terms(words, sign: str) -> str:
    return " ".join(f"{sign} CAST(contains(lower(coalesce(customer_message, '')), '{w}') AS INT)" for w in words)


def lookup(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def sentiment_of(score: str) -> str:
    return (
        f"CASE WHEN {score} <= -2 THEN 'Very Negative' WHEN {score} = -1 THEN 'Negative' "
        f"WHEN {score} = 0 THEN 'Neutral' ELSE 'Positive' END"
    )


SENTIMENT_SCORE = f"(0 {score_terms(C.POSITIVE_WORDS, '+')} {score_terms(C.NEGATIVE_WORDS, '-')})"
NEGATIVE = "sentiment IN ('Negative', 'Very Negative')"

SLA = """
SELECT t.*, date_diff('microsecond', created_at, closed_at) / CAST(3600000000 AS DOUBLE) AS actual_resolution_hours,
       CASE WHEN closed_at IS NOT NULL THEN CASE WHEN closed_at > sla_due_at THEN 'Breached' ELSE 'Met' END
            WHEN TIMESTAMP '1998-01-01 00:00:00' > sla_due_at THEN 'Breached' ELSE 'Open - On Track' END AS sla_status,
       (CASE WHEN closed_at IS NOT NULL THEN closed_at ELSE TIMESTAMP '1998-01-01 00:00:00' END > sla_due_at) IS TRUE
         AS sla_breached
FROM {} t
"""

SCORED = f"""
SELECT *, CASE WHEN escalation_risk_score <= 39 THEN 'Low' WHEN escalation_risk_score <= 69 THEN 'Medium'
               ELSE 'High' END AS risk_level
FROM (SELECT *, CAST(least(100, {lookup('priority', C.PRIORITY_POINTS)} + {lookup('sentiment', C.SENTIMENT_POINTS)}
               + {lookup('sla_status', C.SLA_POINTS)} + least(coalesce(previous_contacts, 0) * 5, 20)
               + CASE WHEN status = 'Escalated' THEN 20 ELSE 0 END
               + CASE WHEN customer_rating <= 2 THEN 10 ELSE 0 END) AS INTEGER) AS escalation_risk_score
      FROM (SELECT *, {sentiment_of(SENTIMENT_SCORE)} AS sentiment FROM sla))
"""

ACTION = """CASE WHEN escalation_risk_score >= 85 OR (sla_status = 'Breached'
    AND sentiment IN ('Negative', 'Very Negative') AND priority IN ('High', 'Critical')) THEN 'Critical Escalation'
  WHEN escalation_risk_score >= 70 THEN 'Manager Review' WHEN escalation_risk_score >= 50 THEN 'Monitor Closely'
  ELSE 'Normal Queue' END"""

FACTORS = """list_filter([
  CASE WHEN priority IN ('High', 'Critical') THEN priority || ' priority ticket' END,
  CASE WHEN sla_status = 'Breached' THEN 'SLA is already breached' END,
  CASE WHEN sentiment IN ('Negative', 'Very Negative') THEN 'Customer sentiment is ' || lower(sentiment) END,
  CASE WHEN previous_contacts >= 3 THEN 'Customer has contacted support ' || previous_contacts || ' times' END,
  CASE WHEN coalesce(customer_rating, 3) <= 2 THEN 'Low customer rating: ' || customer_rating || '/5' END,
  CASE WHEN status = 'Escalated' THEN 'Ticket is already escalated' END,
  CASE WHEN escalation_risk_score >= 85 THEN 'Overall escalation risk score is very high' END],
  lambda f: f IS NOT NULL)"""


def per_level(texts) -> str:
    whens = " ".join(
        f"WHEN '{level}' THEN {fill(t, department='department')}" for level, t in zip(C.ACTION_LEVELS, texts)
    )
    return f"CASE action_level {whens} END"


def triage_trace(extra: str = "") -> str:
    slots = dict(
        ticket_id="ticket_id", sla_status="sla_status", sentiment="sentiment", contacts="previous_contacts",
        score="escalation_risk_score", level="action_level",
    )
    return " || '|' || ".join(fill(line, **slots) for line in (*W.TRACE, W.TRACE_RULES)) + extra


TRIAGED = f"""
SELECT ticket_id, escalation_risk_score AS risk_score, risk_level, sla_status, sentiment, action_level,
       {per_level(W.ACTIONS)} AS recommended_action, {per_level(W.ROUTES)} AS routing_recommendation,
       {per_level(C.URGENCIES)} AS urgency, {per_level(W.REASONS)} AS business_reason,
       CASE WHEN escalation_risk_score >= 85 OR (coalesce(customer_rating, 3) <= 2 AND {NEGATIVE}) THEN '{C.IMPACTS[0]}'
            WHEN status = 'Escalated' OR escalation_risk_score >= 70 THEN '{C.IMPACTS[1]}'
            WHEN escalation_risk_score >= 50 THEN '{C.IMPACTS[2]}' ELSE '{C.IMPACTS[3]}' END AS business_impact,
       array_to_string(factors, '|') AS risk_factors,
       {fill(W.MANAGER_NOTE, ticket_id='ticket_id', level='action_level', department='department', issue='issue_type',
             score='escalation_risk_score', factors="array_to_string(factors, '; ')")} AS internal_manager_note,
       CASE WHEN action_level IN ('Critical Escalation', 'Manager Review')
                 THEN {fill(W.REPLY_URGENT, issue='lower(issue_type)')}
            WHEN {NEGATIVE} THEN {fill(W.REPLY_UPSET, issue='lower(issue_type)')}
            ELSE {fill(W.REPLY_STANDARD, issue='lower(issue_type)')} END AS customer_response_draft,
       {triage_trace()} AS agent_trace, factors
FROM (SELECT * REPLACE (CASE WHEN len(factors) > 0 THEN factors ELSE ['{C.RISK_FACTORS["none"]}'] END AS factors)
      FROM (SELECT *, {ACTION} AS action_level, {FACTORS} AS factors FROM scored))
"""

GROUPS = f"""
  count(ticket_id) AS total_tickets, {rate('count(*) FILTER (sla_breached)', 'count(*)')} AS sla_breach_rate
"""

KPIS = f"""
SELECT count(*) AS total_tickets, count(*) FILTER (status = 'Open') AS open_tickets,
       count(*) FILTER (status = 'Closed') AS closed_tickets, count(*) FILTER (status = 'Escalated') AS escalated_tickets,
       {rate('count(*) FILTER (sla_breached)', 'count(*)')} AS sla_breach_rate,
       {mean('actual_resolution_hours')} AS avg_resolution_hours, {mean('customer_rating')} AS avg_customer_rating,
       count(*) FILTER (risk_level = 'High') AS high_risk_tickets,
       {rate(f'count(*) FILTER ({NEGATIVE})', 'count(*)')} AS negative_sentiment_rate,
       count(*) FILTER (sla_breached) AS breached_tickets, count(*) FILTER ({NEGATIVE}) AS negative_tickets
FROM scored
"""
DEPARTMENTS = f"""
SELECT department, {GROUPS}, {mean('actual_resolution_hours')} AS avg_resolution_hours
FROM sla WHERE department IS NOT NULL GROUP BY department
"""
AGENTS = f"""
SELECT agent, count(ticket_id) AS total_tickets, {mean('actual_resolution_hours')} AS avg_resolution_hours,
       {rate('count(*) FILTER (sla_breached)', 'count(*)')} AS sla_breach_rate,
       {mean('customer_rating')} AS avg_customer_rating, count(*) FILTER (risk_level = 'High') AS high_risk_tickets
FROM scored WHERE agent IS NOT NULL GROUP BY agent
"""
ISSUES = f"""
SELECT issue_type, {GROUPS}, {mean('escalation_risk_score')} AS avg_risk_score,
       {mean('customer_rating')} AS avg_customer_rating
FROM scored WHERE issue_type IS NOT NULL GROUP BY issue_type
"""
ROOT_CAUSES = f"""
SELECT department, issue_type, count(ticket_id) AS total_tickets, count(*) FILTER (sla_breached) AS sla_breaches,
       count(*) FILTER (risk_level = 'High') AS high_risk_tickets, {mean('escalation_risk_score')} AS avg_risk_score,
       {mean('customer_rating')} AS avg_customer_rating
FROM scored GROUP BY department, issue_type
"""
ROOT_ORDER = "ORDER BY high_risk_tickets DESC, sla_breaches DESC, department, issue_type"
OVERLOADED = f"""
SELECT *, CASE WHEN total_tickets > mt AND high_risk_tickets > mh THEN '{C.WORKLOAD_REASONS[0]}'
               WHEN total_tickets > mt THEN '{C.WORKLOAD_REASONS[1]}' ELSE '{C.WORKLOAD_REASONS[2]}' END AS workload_reason
FROM agents, (SELECT avg(total_tickets) AS mt, avg(high_risk_tickets) AS mh FROM agents)
WHERE total_tickets > mt OR high_risk_tickets > mh
"""
TOP = """
SELECT ticket_id, department, issue_type, priority, agent, status, sla_status, sentiment, previous_contacts,
       customer_rating, escalation_risk_score, customer_message
FROM scored ORDER BY escalation_risk_score DESC, ticket_id LIMIT {}
"""

_facts = dict(
    tickets=commas("total_tickets"), high=commas("high_risk_tickets"), negative=commas("negative_tickets"),
)
_brief = {
    "executive_summary": fill(W.BRIEF_SUMMARY, rate="sla_breach_rate", **_facts),
    "sla_risk": fill(W.BRIEF_SLA, department="d.department", rate="d.rate", breached=commas("breached_tickets")),
    "customer_sentiment_risk": fill(W.BRIEF_SENTIMENT, negative=_facts["negative"]),
    "top_issue_risk": fill(W.BRIEF_ISSUE, issue="i.issue_type", tickets="i.n"),
    "workload_risk": fill(W.BRIEF_WORKLOAD, agents="o.overloaded_agents"),
}
_actions = f"""list_filter([
  CASE WHEN sla_breach_rate >= 20 THEN {text(W.ACTION_BREACHES)} END,
  CASE WHEN high_risk_tickets > 0 THEN {fill(W.ACTION_HIGH_RISK, n='least(10, high_risk_tickets)')} END,
  CASE WHEN negative_tickets > 0 THEN {text(W.ACTION_NEGATIVE)} END,
  CASE WHEN o.overloaded_agents > 0 THEN {text(W.ACTION_OVERLOAD)} END,
  {fill(W.ACTION_ISSUE, issue='i.issue_type')}], lambda a: a IS NOT NULL)"""
BRIEF = f"""
SELECT k.* EXCLUDE (breached_tickets, negative_tickets), {', '.join(f'{sql} AS {name}' for name, sql in _brief.items())},
       {_actions} AS actions, o.overloaded_agents
FROM kpis k,
     (SELECT department, sla_breach_rate AS rate FROM departments ORDER BY sla_breach_rate DESC, department LIMIT 1) d,
     (SELECT issue_type, total_tickets AS n FROM issues ORDER BY total_tickets DESC, issue_type LIMIT 1) i,
     (SELECT count(*) AS overloaded_agents FROM overloaded) o
"""
BRIEF_TRACE = text("|".join((*W.BRIEF_TRACE, W.TRACE_RULES)))
TOP_TICKETS = f"(SELECT string_agg(ticket_id, '|' ORDER BY escalation_risk_score DESC, ticket_id) FROM ({TOP.format(10)}))"


def pain_points(n: int) -> str:
    return f"""(SELECT string_agg(department || '/' || issue_type, '|' {ROOT_ORDER})
                FROM (SELECT * FROM root_causes {ROOT_ORDER} LIMIT {n}))"""


def brief_text(heading: str) -> str:
    parts = [text(heading)]
    for name, title in W.BRIEF_TITLES.items():
        parts += ["''", text(f"{title}:"), name]
    numbered = "array_to_string(list_transform(actions, lambda a, i: i || '. ' || a), chr(10))"
    parts += ["''", text(f"{W.ACTIONS_TITLE}:"), numbered]
    return f"concat_ws(chr(10), {', '.join(parts)})"


COSTS_ANALYZED = f"""
SELECT *, CASE WHEN variance_pct > -999 AND variance_pct <= 5 THEN 'Low' WHEN variance_pct > 5 AND variance_pct <= 15
               THEN 'Medium' WHEN variance_pct > 15 AND variance_pct <= 999 THEN 'High' ELSE 'nan' END AS risk_level
FROM (SELECT *, {rate('variance', 'budget_amount', 1)} AS variance_pct,
             round_even(greatest(CAST(variance AS DOUBLE) * CAST(0.45 AS DOUBLE), CAST(0 AS DOUBLE)), 0) AS savings_opportunity
      FROM (SELECT *, actual_amount - budget_amount AS variance FROM costs))
"""
COST_TOTALS = """
SELECT CAST(sum(actual_amount) AS BIGINT) AS total_spend, CAST(sum(budget_amount) AS BIGINT) AS total_budget,
       CAST(sum(actual_amount) - sum(budget_amount) AS BIGINT) AS variance, sum(savings_opportunity) AS savings
FROM analyzed
"""
LEADERS = """
SELECT *, (SELECT department FROM analyzed GROUP BY department ORDER BY sum(variance) DESC, department LIMIT 1) AS department,
       (SELECT vendor FROM analyzed GROUP BY vendor ORDER BY sum(actual_amount) DESC, vendor LIMIT 1) AS vendor
FROM cost_totals
"""
_cost_slots = dict(
    actual=commas("total_spend"), budget=commas("total_budget"), variance=commas("variance"),
    savings=commas("savings"), department="department", vendor="vendor",
)
_report_lines = [text(W.COST_REPORT_HEADING), "''", *[fill(line, **_cost_slots) for line in W.COST_REPORT_LINES]]
COST_REPORT = f"SELECT concat_ws(chr(10), {', '.join(_report_lines)}) AS report FROM leaders"
COST_SUMMARY = f"SELECT {fill(W.COST_SUMMARY, **_cost_slots)} AS summary FROM leaders"
SUPPORT_SUMMARY = f"""
SELECT *, {fill(W.SUPPORT_SUMMARY, tickets='total_tickets', rate='sla_breach_rate', department='top_department')} AS summary
FROM (SELECT count(*) AS total_tickets, {rate('count(*) FILTER (sla_breached)', 'count(*)', 1)} AS sla_breach_rate,
             (SELECT department FROM sla WHERE department IS NOT NULL GROUP BY department
              ORDER BY count(*) DESC, department LIMIT 1) AS top_department FROM sla)
"""

def asked(prompt: str, answer: str, summary: str) -> str:
    return f"""SELECT question_id, {fill(prompt, summary='summary', question='question')} AS prompt,
               {fill(answer, summary='summary')} AS fallback_answer FROM questions, (SELECT summary FROM {summary})"""


STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def keyword_table(view: str, key: str) -> str:
    return f"""
    SELECT {key}, keyword, CAST(count(*) AS INTEGER) AS n, CAST(min(pos) AS INTEGER) AS first_pos
    FROM (SELECT {key}, unnest(l) AS keyword, generate_subscripts(l, 1) - 1 AS pos
          FROM (SELECT {key}, list_filter(regexp_extract_all(lower(text), '{C.KEYWORD_PATTERN}'),
                       lambda w: length(w) >= 3 AND w NOT IN ({STOP})) AS l FROM {view}))
    GROUP BY {key}, keyword"""


def ranked_table(counts: str, key: str) -> str:
    return f"""
    SELECT {key}, rank, keyword, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first_pos)
    AS INTEGER) AS rank FROM {counts}) WHERE rank <= 35"""


MATCHES = """
SELECT resume_id, jd_id, CAST(round_even(CAST(found AS DOUBLE) / greatest(wanted, 1) * CAST(100 AS DOUBLE), 0) AS INTEGER) AS score,
       matched, missing, found, wanted
FROM (SELECT p.resume_id, p.jd_id, count(j.keyword) AS wanted, count(r.keyword) AS found,
             coalesce(list(j.keyword ORDER BY j.rank) FILTER (r.keyword IS NOT NULL), []) AS matched,
             coalesce(list(j.keyword ORDER BY j.rank) FILTER (j.keyword IS NOT NULL AND r.keyword IS NULL), []) AS missing
      FROM (SELECT DISTINCT resume_id, jd_id FROM applications) p
      LEFT JOIN jd_keywords j ON p.jd_id = j.jd_id
      LEFT JOIN resume_keywords r ON p.resume_id = r.resume_id AND j.keyword = r.keyword
      GROUP BY p.resume_id, p.jd_id)
"""


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def advice(keywords: str, line: str, nothing: str) -> str:
    made = f"list_transform({keywords}[1:{W.ADVICE_ITEMS}], lambda k: {fill(line, keyword='k')})"
    return f"CASE WHEN len({keywords}) > 0 THEN {made} ELSE [{text(nothing)}] END"


IMPROVEMENTS = advice("missing", W.IMPROVEMENT, W.NOTHING_MISSING)
INTERVIEW = advice("matched", W.QUESTION, W.NOTHING_MATCHED)


FEEDBACK = f"""
SELECT m.resume_id, m.jd_id, m.score, f.reply,
       CASE WHEN resume_id % 4 = 0 THEN 'Good fit' ELSE {fill(W.FEEDBACK, score='score')} END AS overall_feedback,
       CASE WHEN resume_id % 4 = 0 THEN ['sql', 'reports'] ELSE matched[1:8] END AS strengths,
       CASE WHEN resume_id % 4 = 0 THEN [] ELSE missing[1:8] END AS gaps,
       {IMPROVEMENTS} AS resume_improvements,
       CASE WHEN resume_id % 4 = 1 THEN ['Why us?'] ELSE {INTERVIEW} END AS interview_questions,
       CASE WHEN resume_id % 4 < 2 THEN {strings([W.FEEDBACK_TRACE, W.FEEDBACK_REPLY_TRACE])}
            WHEN resume_id % 4 = 2 THEN {strings([W.FEEDBACK_TRACE, W.FEEDBACK_BAD_REPLY])}
            ELSE {strings([W.FEEDBACK_TRACE])} END AS agent_trace
FROM matches m JOIN (SELECT DISTINCT resume_id, jd_id, reply FROM feedback_replies) f USING (resume_id, jd_id)
"""


def numbered(items: str) -> str:
    return f"coalesce(array_to_string(list_transform({items}, lambda a, i: i || '. ' || a), chr(10)), '')"


def bulleted(items: str) -> str:
    return f"coalesce(array_to_string(list_transform({items}, lambda a: '- ' || a), chr(10)), '')"


def report(*sections) -> str:
    parts = [text(W.CANDIDATE_HEADING), "''", fill(W.CANDIDATE_SCORE, score="score")]
    for title, body in sections:
        parts += ["''", text(f"{title}:"), body]
    return f"concat_ws(chr(10), {', '.join(parts)})"


def redacted(value: str) -> str:
    for pattern, mark, flags in (
        (C.EMAIL_PATTERN, C.EMAIL_MARK, "gi"), (C.PHONE_PATTERN, C.PHONE_MARK, "g"), (C.ID_PATTERN, C.ID_MARK, "gi"),
    ):
        value = f"regexp_replace({value}, {text(pattern)}, {text(mark)}, '{flags}')"
    return value


def cut(value: str) -> str:
    return f"CASE WHEN length({value}) > 12000 THEN substr({value}, 1, 12000) || {text(C.TRUNCATION_MARK)} ELSE {value} END"


def as_json(**fields: str) -> str:
    return "to_json({" + ", ".join(f"'{name}': {sql}" for name, sql in fields.items()) + "})"


def _plain_time(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


_TIMES = ("created_at", "sla_due_at", "closed_at")
_TICKET = as_json(**{
    name: _plain_time(name) if name in _TIMES else name
    for name in (
        "ticket_id", "customer_id", "department", "issue_type", "priority", "agent", "channel", "created_at", "sla_due_at",
        "closed_at", "status", "resolution_hours", "previous_contacts", "customer_message", "customer_rating",
        "actual_resolution_hours", "sla_status", "sla_breached", "sentiment", "escalation_risk_score", "risk_level",
    )
})
_TRIAGE = as_json(**{
    name: {"risk_factors": "t.factors", "agent_trace": "string_split(t.agent_trace, '|')"}.get(name, f"t.{name}")
    for name in (
        "ticket_id", "risk_score", "risk_level", "sla_status", "sentiment", "action_level", "recommended_action",
        "routing_recommendation", "urgency", "business_reason", "business_impact", "risk_factors", "internal_manager_note",
        "customer_response_draft", "agent_trace",
    )
})
TRIAGE_PROMPTS = f"""
SELECT ticket_id, {fill(
    W.TRIAGE_PROMPT,
    keys="'risk_score, risk_level, sla_status, sentiment, action_level, recommended_action, routing_recommendation, "
         "urgency, business_reason, business_impact, risk_factors, internal_manager_note, customer_response_draft, agent_trace'",
    ticket="s.ticket", baseline=_TRIAGE,
)} AS prompt
FROM triaged t JOIN (SELECT ticket_id, {_TICKET} AS ticket FROM scored) s USING (ticket_id)
"""
_KPI_JSON = as_json(**{name: name for name in (
    "total_tickets", "open_tickets", "closed_tickets", "escalated_tickets", "sla_breach_rate", "avg_resolution_hours",
    "avg_customer_rating", "high_risk_tickets", "negative_sentiment_rate",
)})
BRIEFING_PROMPT = f"""
SELECT {fill(
    W.BRIEFING_PROMPT, keys="'briefing_sections, recommended_actions, agent_trace'", sections=text(', '.join(W.BRIEF_TITLES)),
    payload=as_json(kpis=_KPI_JSON, baseline_sections=as_json(**{n: n for n in W.BRIEF_TITLES}), baseline_recommended_actions='actions'),
)} AS prompt FROM brief
"""


CANDIDATE_PROMPTS = f"""
SELECT m.resume_id, m.jd_id, {fill(
    W.CANDIDATE_PROMPT,
    keys="'overall_feedback, strengths, gaps, resume_improvements, interview_questions, agent_trace'",
    score='score', matched="array_to_string(matched, ', ')", missing="array_to_string(missing, ', ')",
    resume=redacted("r.text"), jd=redacted("j.text"),
)} AS prompt
FROM matches m JOIN resumes r USING (resume_id) JOIN jds j ON m.jd_id = j.jd_id
"""

REPLY_JSON = "SELECT ticket_id, reply, regexp_extract(reply, '\\{.*\\}', 0, 's') AS j FROM replies"
REPLY_TEXTS = (
    "risk_level", "sla_status", "sentiment", "action_level", "recommended_action", "routing_recommendation", "urgency",
    "business_reason", "business_impact", "internal_manager_note", "customer_response_draft",
)
PARSED = f"""
SELECT ticket_id, coalesce(j <> '' AND json_valid(j), FALSE) AS is_valid, reply,
       CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.risk_score') AS INTEGER) END AS risk_score,
       {', '.join(f"CASE WHEN json_valid(j) THEN json_extract_string(j, '$.{f}') END AS {f}" for f in REPLY_TEXTS)},
       {', '.join(f'''CASE WHEN json_valid(j) AND json_exists(j, '$.{f}')
                      THEN array_to_string(json_extract_string(j, '$.{f}[*]'), '|') END AS {f}'''
                  for f in ('risk_factors', 'agent_trace'))}
FROM reply_json
"""
MERGED = f"""
SELECT ticket_id, {', '.join(f'coalesce(p.{f}, t.{f}) AS {f}' for f in ('risk_score', *REPLY_TEXTS, 'risk_factors'))},
       coalesce(p.agent_trace, t.agent_trace) || CASE WHEN is_valid THEN {text('|' + W.TRACE_REPLY)}
         WHEN coalesce(reply, '') <> '' THEN {text('|' + W.TRACE_BAD_REPLY)} ELSE '' END AS agent_trace,
       CASE WHEN is_valid THEN 'model' ELSE 'rules' END AS mode
FROM triaged t JOIN parsed p USING (ticket_id)
"""

TRIM = "trim({}, ' ')"
CLEANED = f"""
SELECT {', '.join(f"{TRIM.format(c)} AS {c}" for c in C.TRIMMED_COLUMNS[:-1])}, {TRIM.format('customer_message')} AS customer_message,
       created_at, sla_due_at, closed_at,
       coalesce(TRY_CAST(trunc(TRY_CAST(previous_contacts AS DOUBLE)) AS INTEGER), 0) AS previous_contacts,
       coalesce(TRY_CAST(trunc(TRY_CAST(customer_rating AS DOUBLE)) AS INTEGER), 3) AS customer_rating
FROM tickets_raw
"""


def quality(view: str) -> str:
    nulls = " + ".join(f"CAST({c} IS NULL AS INT)" for c in C.REQUIRED_TICKET_COLUMNS)
    counters = f"""
    SELECT count(*) AS total_rows, CAST({len(C.REQUIRED_TICKET_COLUMNS)} AS INTEGER) AS total_columns,
           CAST(sum({nulls}) AS BIGINT) AS missing_value_total,
           (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {view} GROUP BY ticket_id)) AS duplicate_ticket_count,
           count(*) FILTER (priority IS NULL OR priority NOT IN ('Low', 'Medium', 'High', 'Critical')) AS invalid_priority_count,
           count(*) FILTER (status IS NULL OR status NOT IN ('Open', 'Closed', 'Escalated')) AS invalid_status_count,
           count(*) FILTER (TRY_CAST(created_at AS TIMESTAMP) IS NULL) + count(*) FILTER (TRY_CAST(sla_due_at AS TIMESTAMP) IS NULL)
             + count(*) FILTER (closed_at IS NOT NULL AND TRY_CAST(closed_at AS TIMESTAMP) IS NULL) AS invalid_date_count,
           count(*) FILTER (customer_message IS NULL OR trim(customer_message) = '') AS missing_message_count
    FROM {view}"""
    issues = ", ".join(f"CASE WHEN {name} > 0 THEN {fill(line, n=name)} END" for name, line, _, _ in C.QUALITY_RULES)
    issues += f", CASE WHEN missing_value_total > 0 THEN {fill(C.MISSING_VALUES_LINE, n='missing_value_total')} END"
    return f"""
    SELECT *, CAST(greatest(0, 100 - (least(duplicate_ticket_count * 2, 20) + least(invalid_priority_count * 2, 15)
                + least(invalid_status_count * 2, 15) + least(invalid_date_count * 2, 20) + least(missing_message_count, 15)
                + least(missing_value_total // greatest(total_rows, 1), 15))) AS INTEGER) AS quality_score,
           coalesce(nullif(concat_ws('|', {issues}), ''), {text(C.NO_ISSUES_LINE)}) AS issues
    FROM ({counters})"""


RECOMMENDATIONS = []
for _position, (_key, _what, _why, _advice, _impact, _difficulty) in enumerate(W.RECOMMENDATIONS, start=1):
    _source = {
        "department": "(SELECT department AS name, sla_breach_rate AS value, '' AS more FROM departments "
                      "ORDER BY sla_breach_rate DESC, department LIMIT 1)",
        "issue": "(SELECT issue_type AS name, total_tickets AS value, '' AS more FROM issues "
                 "ORDER BY total_tickets DESC, issue_type LIMIT 1)",
        "sentiment": "(SELECT '' AS name, negative_sentiment_rate AS value, '' AS more FROM kpis "
                     "WHERE negative_sentiment_rate > 20)",
        "agent": "(SELECT agent AS name, total_tickets AS value, '' AS more FROM agents "
                 "ORDER BY total_tickets DESC, agent LIMIT 1)",
        "pain_point": "(SELECT issue_type || ' in ' || department AS name, high_risk_tickets AS value, "
                      f"sla_breaches AS more FROM root_causes {ROOT_ORDER} LIMIT 1)",
    }[_key]
    _slots = dict(name="name", value="value", more="more")
    RECOMMENDATIONS.append(
        f"SELECT CAST({_position} AS INTEGER) AS position, {fill(_what, **_slots)} AS opportunity, "
        f"{fill(_why, **_slots)} AS reason, {text(_advice)} AS recommendation, {text(_impact)} AS impact, "
        f"{text(_difficulty)} AS difficulty FROM {_source}"
    )

CTES = {
    **VIEWS,
    "sla": SLA.format("tickets"),
    "scored": SCORED,
    "triaged": TRIAGED,
    "kpis": KPIS,
    "departments": DEPARTMENTS,
    "agents": AGENTS,
    "issues": ISSUES,
    "root_causes": ROOT_CAUSES,
    "overloaded": OVERLOADED,
    "brief": BRIEF,
    "analyzed": COSTS_ANALYZED,
    "cost_totals": COST_TOTALS,
    "leaders": LEADERS,
    "cost_summary": COST_SUMMARY,
    "support_summary": SUPPORT_SUMMARY,
    "jd_counts": keyword_table("jds", "jd_id"),
    "jd_keywords": ranked_table("jd_counts", "jd_id"),
    "resume_keywords": keyword_table("resumes", "resume_id"),
    "matches": MATCHES,
    "feedback": FEEDBACK,
    "reply_json": REPLY_JSON,
    "parsed": PARSED,
    "cleaned": CLEANED,
}
NEEDS = {
    "tickets_raw": ["tickets"], "replies": ["tickets"], "feedback_replies": ["applications"],
    "sla": ["tickets"], "scored": ["sla"], "triaged": ["scored"], "kpis": ["scored"], "departments": ["sla"],
    "agents": ["scored"], "issues": ["scored"], "root_causes": ["scored"], "overloaded": ["agents"],
    "brief": ["kpis", "departments", "issues", "overloaded", "root_causes"], "analyzed": ["costs"],
    "cost_totals": ["analyzed"], "leaders": ["cost_totals"], "cost_summary": ["leaders"], "support_summary": ["sla"],
    "jd_counts": ["jds"], "jd_keywords": ["jd_counts"], "resume_keywords": ["resumes"],
    "matches": ["applications", "jd_keywords", "resume_keywords"], "feedback": ["matches", "feedback_replies"],
    "reply_json": ["replies"], "parsed": ["reply_json"], "cleaned": ["tickets_raw"],
}


def statement(select: str, *uses: str) -> str:
    """The select with the CTEs it uses, and the ones those need, in order of definition."""
    wanted, todo = set(), list(uses)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += NEEDS.get(name, [])
    ctes = [f"{name} AS ({sql})" for name, sql in CTES.items() if name in wanted]
    ctes.sort(key=lambda c: list(CTES).index(c.split(" ", 1)[0]))
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


_FEEDBACK_LISTS = ", ".join(
    f"array_to_string({c}, '|') AS {c}"
    for c in ("strengths", "gaps", "resume_improvements", "interview_questions", "agent_trace")
)
_BRIEF_COLUMNS = "* EXCLUDE (actions), array_to_string(actions, '|') AS recommended_actions"
_FINDINGS_TRACE = " || '|' || ".join(
    [
        fill(W.FINDINGS_TRACE[0], tickets=commas("total_tickets")),
        fill(W.QUESTION_TRACE, question="'What is most urgent?'"),
        text(W.SCORED_TRACE),
        *[text(step) for step in W.FINDINGS_TRACE[1:]],
        BRIEF_TRACE,
    ]
)
_RAW_REST = (
    "customer_id", "department", "issue_type", "priority", "agent", "channel", "sla_due_at", "closed_at", "status",
    "previous_contacts", "customer_message", "customer_rating",
)

_SQL = {
    "sla_by_department": ("SELECT * FROM departments", "departments"),
    "sla_by_priority": (
        f"SELECT priority, {GROUPS}, {mean('actual_resolution_hours')} AS avg_resolution_hours FROM sla "
        "WHERE priority IS NOT NULL GROUP BY priority", "sla",
    ),
    "sql_breach_rate": (
        "SELECT department, count(*) AS total_tickets, CAST(SUM(CASE WHEN closed_at > sla_due_at THEN 1 ELSE 0 END) "
        "AS DOUBLE) * CAST(100 AS DOUBLE) / count(*) AS sla_breach_rate FROM tickets GROUP BY department", "tickets",
    ),
    "sql_issue_volume": ("SELECT issue_type, count(*) AS total_tickets FROM tickets GROUP BY issue_type", "tickets"),
    "sql_agent_workload": (
        "SELECT agent, count(*) AS total_tickets, avg(resolution_hours) AS avg_resolution_hours FROM tickets GROUP BY agent",
        "tickets",
    ),
    "ticket_sentiment": ("SELECT ticket_id, customer_message, sentiment FROM scored", "scored"),
    "document_sentiment": (
        f"SELECT {sentiment_of(SENTIMENT_SCORE)} AS sentiment, count(*) AS documents "
        "FROM (SELECT text AS customer_message FROM documents) GROUP BY 1",
    ),
    "turn_sentiment": (
        f"""SELECT conv_id, turn, {sentiment_of(SENTIMENT_SCORE)} AS sentiment FROM (
            SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'thanks, great ' WHEN 1 THEN 'angry, unhappy: ' ELSE '' END
                                  || coalesce(text, '') AS customer_message FROM conversations)""",
    ),
    "us_times_sla": ("SELECT * FROM departments", "departments"),
    "declared_table": (
        "SELECT department, priority, count(*) AS tickets, count(closed_at) AS closed, CAST(sum(previous_contacts) AS BIGINT) AS contacts "
        "FROM tickets GROUP BY department, priority", "tickets",
    ),
    "scored_tickets": ("SELECT * FROM scored", "scored"),
    "support_kpis": ("SELECT * FROM kpis", "kpis"),
    "agent_performance": ("SELECT * FROM agents", "agents"),
    "issue_summary": ("SELECT * FROM issues", "issues"),
    "risk_histogram": ("SELECT risk_level, count(*) AS count FROM scored GROUP BY risk_level", "scored"),
    "root_cause": ("SELECT * FROM root_causes", "root_causes"),
    "top_pain_points": (f"SELECT * FROM root_causes {ROOT_ORDER} LIMIT 10", "root_causes"),
    "top_risk_tickets": (TOP.format(20), "scored"),
    "customers_to_contact": (
        f"SELECT customer_id, count(*) AS negative_tickets, count(*) FILTER (sla_breached) AS breached_negative_tickets, "
        f"max(escalation_risk_score) AS highest_risk_score FROM scored WHERE {NEGATIVE} GROUP BY customer_id", "scored",
    ),
    "overloaded_agents": ("SELECT * EXCLUDE (mt, mh) FROM overloaded", "overloaded"),
    "clean_tickets": ("SELECT * FROM cleaned", "cleaned"),
    "quality_report": (quality("tickets_raw"), "tickets_raw"),
    "clean_quality_report": (quality("cleaned"), "cleaned"),
    "duplicate_rows": (
        f"""SELECT ticket_id, customer_id, created_at, count(*) AS later_occurrences
            FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at NULLS FIRST,
                  {', '.join(c + ' NULLS FIRST' for c in _RAW_REST)}) AS rn FROM tickets_raw)
            WHERE rn > 1 GROUP BY ticket_id, created_at, {', '.join(_RAW_REST)}""", "tickets_raw",
    ),
    "cleaned_sla_by_department": (
        f"""SELECT department, {GROUPS}, {mean('actual_resolution_hours')} AS avg_resolution_hours
            FROM ({SLA.format('''(SELECT * REPLACE (TRY_CAST(created_at AS TIMESTAMP) AS created_at,
                  TRY_CAST(sla_due_at AS TIMESTAMP) AS sla_due_at, TRY_CAST(closed_at AS TIMESTAMP) AS closed_at)
                  FROM cleaned)''')}) GROUP BY department""", "cleaned",
    ),
    "ticket_triage": ("SELECT * EXCLUDE (factors) FROM triaged", "triaged"),
    "ticket_actions": (
        "SELECT action_level, urgency, business_impact, count(*) AS tickets FROM triaged GROUP BY ALL", "triaged",
    ),
    "risk_factors": (
        "SELECT risk_factor, count(*) AS tickets FROM (SELECT unnest(factors) AS risk_factor FROM triaged) GROUP BY 1",
        "triaged",
    ),
    "recommendations": (" UNION ALL ".join(f"({r})" for r in RECOMMENDATIONS), "departments", "issues", "kpis", "agents", "root_causes"),
    "daily_briefing": (
        f"""SELECT {_BRIEF_COLUMNS}, {TOP_TICKETS} AS top_tickets, {pain_points(5)} AS pain_points,
            {BRIEF_TRACE} AS agent_trace, {brief_text(W.BRIEF_HEADING)} AS report FROM brief""", "brief", "scored",
    ),
    "findings": (
        f"""SELECT 'success' AS status, 'rules' AS mode, {_FINDINGS_TRACE} AS agent_trace,
            'What is most urgent?' AS user_question,
            * EXCLUDE (actions, overloaded_agents, {', '.join(W.BRIEF_TITLES)}),
            CAST(least(10, total_tickets) AS INTEGER) AS top_tickets,
            CAST((SELECT least(10, count(*)) FROM root_causes) AS INTEGER) AS pain_points,
            {brief_text(W.MANAGER_HEADING)} AS manager_briefing, array_to_string(actions, '|') AS recommended_actions
            FROM brief""", "brief",
    ),
    "merged_briefing": (
        f"""SELECT {_BRIEF_COLUMNS.replace('(actions)', '(actions, sla_risk)')}, 'Look at SLA.' AS sla_risk,
            {TOP_TICKETS} AS top_tickets, {pain_points(5)} AS pain_points,
            {text('read|' + W.TRACE_REPLY)} AS agent_trace, 'model' AS mode FROM brief""", "brief", "scored",
    ),
    "dataset_summary": ("SELECT * FROM support_summary", "support_summary"),
    "support_questions": (asked(W.SUPPORT_QUESTION, W.SUPPORT_ANSWER, "support_summary"), "questions", "support_summary"),
    "cost_questions": (asked(W.COST_QUESTION, W.COST_ANSWER, "cost_summary"), "questions", "cost_summary"),
    "answered_questions": (
        f"""SELECT q.question_id, coalesce(CASE WHEN c.text <> '' THEN trim(c.text, ' ' || chr(9) || chr(10) || chr(13)) END,
            fallback_answer) AS answer FROM ({asked(W.SUPPORT_QUESTION, W.SUPPORT_ANSWER, 'support_summary')}) q
            LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') c
            ON q.question_id = c.conv_id || '-' || (c.turn - 1)""", "questions", "support_summary",
    ),
    "cost_analysis": ("SELECT * FROM analyzed", "analyzed"),
    "cost_totals": ("SELECT * FROM cost_totals", "cost_totals"),
    "cost_by_month": (
        "SELECT date, CAST(sum(budget_amount) AS BIGINT) AS budget_amount, CAST(sum(actual_amount) AS BIGINT) AS actual_amount "
        "FROM analyzed WHERE date IS NOT NULL GROUP BY date", "analyzed",
    ),
    "cost_by_category_risk": (
        "SELECT cost_category, risk_level, CAST(sum(variance) AS BIGINT) AS variance FROM analyzed GROUP BY ALL", "analyzed",
    ),
    "cost_by_department": (
        "SELECT department, CAST(sum(budget_amount) AS BIGINT) AS budget_amount, CAST(sum(actual_amount) AS BIGINT) AS "
        "actual_amount, CAST(sum(variance) AS BIGINT) AS variance, sum(savings_opportunity) AS savings_opportunity "
        "FROM analyzed GROUP BY department", "analyzed",
    ),
    "vendor_share": (
        "SELECT vendor, CAST(sum(actual_amount) AS BIGINT) AS actual_amount, CAST(sum(actual_amount) AS DOUBLE) / "
        "(SELECT CAST(sum(actual_amount) AS DOUBLE) FROM analyzed) AS share FROM analyzed GROUP BY vendor", "analyzed",
    ),
    "cost_report": (COST_REPORT, "leaders"),
    "report_roundtrip": (f"SELECT unnest(string_split(report, chr(10))) AS line FROM ({COST_REPORT})", "leaders"),
    "roi_by_department": (
        "SELECT *, monthly_savings + labor_savings AS total_value FROM (SELECT department, CAST(sum(actual_amount) AS BIGINT) "
        "AS actual_amount, CAST(sum(actual_amount) AS DOUBLE) * CAST(8 AS DOUBLE) / CAST(100 AS DOUBLE) AS monthly_savings, "
        "CAST(700 AS DOUBLE) AS labor_savings FROM analyzed GROUP BY department)", "analyzed",
    ),
    "redacted_documents": (f"SELECT doc_id AS resume_id, {redacted('text')} AS redacted FROM documents",),
    "truncated_documents": (f"SELECT doc_id AS resume_id, {cut('text')} AS truncated FROM documents",),
    "keyword_counts": ("SELECT * FROM resume_keywords", "resume_keywords"),
    "jd_top_keywords": ("SELECT * FROM jd_keywords", "jd_keywords"),
    "resume_top_keywords": (ranked_table("resume_keywords", "resume_id"), "resume_keywords"),
    "resume_match": (
        "SELECT resume_id, jd_id, score, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing "
        "FROM matches", "matches",
    ),
    "keyword_coverage": (
        "SELECT resume_id, jd_id, 'Matched' AS category, found AS count FROM matches UNION ALL "
        "SELECT resume_id, jd_id, 'Missing', wanted - found FROM matches", "matches",
    ),
    "candidate_feedback": (
        f"""SELECT resume_id, jd_id, score, {fill(W.FEEDBACK, score='score')} AS overall_feedback,
            array_to_string(matched[1:8], '|') AS strengths, array_to_string(missing[1:8], '|') AS gaps,
            array_to_string({IMPROVEMENTS}, '|') AS resume_improvements, array_to_string({INTERVIEW}, '|') AS interview_questions,
            {text(W.FEEDBACK_TRACE)} AS agent_trace FROM matches""", "matches",
    ),
    "validated_feedback": (
        f"SELECT resume_id, jd_id, score, overall_feedback, {_FEEDBACK_LISTS} FROM feedback", "feedback",
    ),
    "candidate_report": (
        f"""SELECT resume_id, jd_id, {report(
            ('Matched keywords', "coalesce(array_to_string(matched[1:20], ', '), '')"),
            ('Missing keywords', "coalesce(array_to_string(missing[1:20], ', '), '')"),
            ('Improvements', numbered(IMPROVEMENTS)),
            ('Interview questions', numbered(INTERVIEW)))} AS report FROM matches""", "matches",
    ),
    "feedback_report": (
        f"""SELECT resume_id, jd_id, {report(
            ('Feedback', 'overall_feedback'), ('Strengths', bulleted('strengths')), ('Gaps', bulleted('gaps')),
            ('Improvements', numbered('resume_improvements')), ('Interview questions', numbered('interview_questions')),
            ('Steps', bulleted('agent_trace')))} AS report FROM feedback""", "feedback",
    ),
    "candidate_prompts": (CANDIDATE_PROMPTS, "matches", "resumes", "jds"),
    "parsed_replies": ("SELECT * EXCLUDE (reply) FROM parsed", "parsed"),
    "merged_triage": (MERGED, "triaged", "parsed"),
    "csv_roundtrip": ("SELECT *, 'roundtrip' AS source FROM tickets", "tickets"),
    "triage_prompts": (TRIAGE_PROMPTS, "triaged", "scored"),
    "logged_replies": (
        f"""SELECT ticket_id, '{{"risk_score": ' || length(prompt) % 101 || ', "urgency": "' || right(prompt, 1) || '"}}' AS reply,
            1 AS asked FROM ({TRIAGE_PROMPTS})""", "triaged", "scored",
    ),
    "ticket_lookup": ("SELECT * FROM scored WHERE ticket_id IN (SELECT ticket_id FROM replies)", "scored", "replies"),
    "briefing_prompt": (BRIEFING_PROMPT, "brief"),
    "guarded_csv": (
        "SELECT department, issue_type, agent, count(*) AS tickets FROM tickets GROUP BY ALL", "tickets",
    ),
    "stream_scored_tickets": ("SELECT * FROM scored", "scored"),
    "stream_breach_windows": (
        """SELECT w AS window_start, w + INTERVAL '7 days' AS window_end, department, count(*) AS total_tickets,
           count(*) FILTER (sla_breached) AS breached_tickets
           FROM (SELECT *, time_bucket(INTERVAL '7 days', created_at, TIMESTAMP '1970-01-01 00:00:00') AS w FROM sla)
           GROUP BY w, department""", "sla",
    ),
}


# The same rows by another road.
_SQL["stored_match"] = _SQL["resume_match"]
_SQL["stream_duplicate_rows"] = _SQL["duplicate_rows"]


def all_sql() -> dict[str, str]:
    return {name: statement(select, *uses) for name, (select, *uses) in _SQL.items()}
