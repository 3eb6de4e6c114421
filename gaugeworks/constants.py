"""The domains, points, thresholds, patterns and labels results depend on."""

from datetime import datetime

# --- Fixed values: tickets -------------------------------------------------------------------
REQUIRED_TICKET_COLUMNS = (
    "ticket_id", "customer_id", "department", "issue_type", "priority", "agent", "channel",
    "created_at", "sla_due_at", "closed_at", "status", "previous_contacts", "customer_message",
    "customer_rating",
)
TRIMMED_COLUMNS = (
    "ticket_id", "customer_id", "department", "issue_type", "priority", "agent", "channel",
    "status", "customer_message",
)
PRIORITIES = ("Low", "Medium", "High", "Critical")
STATUSES = ("Open", "Closed", "Escalated")
INTEGER_DEFAULTS = {"previous_contacts": 0, "customer_rating": 3}
AS_OF = datetime(2026, 1, 1)

# --- Fixed values: sentiment and risk --------------------------------------------------------
NEGATIVE_WORDS = ("frustrating", "tired", "unhappy", "cancel", "nobody", "immediately", "waiting", "affecting")
POSITIVE_WORDS = ("thanks", "thank", "helpful", "appreciate", "quick", "well")
NEGATIVE_LABELS = ("Negative", "Very Negative")
PRIORITY_POINTS = {"Low": 5, "Medium": 15, "High": 25, "Critical": 35}
SENTIMENT_POINTS = {"Positive": 0, "Neutral": 5, "Negative": 15, "Very Negative": 25}
SLA_POINTS = {"Met": 0, "Open - On Track": 5, "At Risk": 15, "Breached": 25}
CONTACT_POINTS, CONTACT_POINTS_CAP = 5, 20
ESCALATED_POINTS, LOW_RATING_POINTS, LOW_RATING, MAX_SCORE = 20, 10, 2, 100
RISK_BAND = ((-1, 39, 69, 100), ("Low", "Medium", "High"))
UNBANDED = "nan"

# --- Fixed values: triage --------------------------------------------------------------------
CRITICAL_SCORE, REVIEW_SCORE, MONITOR_SCORE = 85, 70, 50
MANY_CONTACTS = 3
ACTION_LEVELS = ("Critical Escalation", "Manager Review", "Monitor Closely", "Normal Queue")
URGENCIES = ("Immediate", "High", "Medium", "Normal")
IMPACTS = (
    "High customer churn or complaint risk",
    "High support escalation risk",
    "Moderate customer experience risk",
    "Low immediate business risk",
)
RISK_FACTORS = {
    "priority": "{priority} priority ticket",
    "breached": "SLA is already breached",
    "at_risk": "Ticket is close to SLA breach",
    "sentiment": "Customer sentiment is {sentiment}",
    "contacts": "Customer has contacted support {contacts} times",
    "rating": "Low customer rating: {rating}/5",
    "escalated": "Ticket is already escalated",
    "score": "Overall escalation risk score is very high",
    "none": "No major escalation indicators found",
}
WORKLOAD_REASONS = (
    "High ticket volume and high-risk workload",
    "High ticket volume",
    "High-risk workload",
)
BREACH_ALERT_RATE, NEGATIVE_ALERT_RATE = 20, 20

# --- Fixed values: data quality --------------------------------------------------------------
# (counter, issue line, points per finding, largest penalty)
QUALITY_RULES = (
    ("duplicate_ticket_count", "{n} duplicate ticket IDs found", 2, 20),
    ("invalid_priority_count", "{n} invalid priority values found", 2, 15),
    ("invalid_status_count", "{n} invalid status values found", 2, 15),
    ("invalid_date_count", "{n} invalid date values found", 2, 20),
    ("missing_message_count", "{n} missing customer messages found", 1, 15),
)
MISSING_VALUES_LINE, MISSING_VALUES_CAP = "{n} total missing values found", 15
NO_ISSUES_LINE = "No major data quality issues found"

# --- Fixed values: spend ---------------------------------------------------------------------
REQUIRED_COST_COLUMNS = ("date", "department", "cost_category", "vendor", "budget_amount", "actual_amount")
VARIANCE_BAND = ((-999, 5, 15, 999), ("Low", "Medium", "High"))
SAVINGS_FRACTION = 0.45
HOURLY_VALUE = 35

# --- Fixed values: text ----------------------------------------------------------------------
EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"\+?\d[\d\s().-]{7,}\d"
ID_PATTERN = r"\b(?:CUST|TICKET|ID|SSN|EMP)[-_ ]?\d{3,}\b"
EMAIL_MARK, PHONE_MARK, ID_MARK = "[REDACTED_EMAIL]", "[REDACTED_PHONE]", "[REDACTED_ID]"
TRUNCATION_MARK = "\n[TRUNCATED]"
MAX_TEXT_CHARS, MAX_QUESTION_CHARS = 12_000, 500
KEYWORD_PATTERN = r"[a-z][a-z+#.]+"
MIN_KEYWORD_CHARS = 3
STOP_WORDS = (
    "and", "the", "for", "with", "using", "use", "to", "of", "in", "a", "an", "or", "by", "from",
    "on", "as", "is", "are", "be", "this", "that", "business", "analyst", "responsibilities",
    "required", "skills", "experience", "education",
)
TOP_KEYWORDS = 35

# --- Fixed values: replies and uploads -------------------------------------------------------
MAX_REPLY_ITEMS, MAX_REPLY_ITEM_CHARS, MAX_REPLY_CHARS = 8, 180, 1_200
MAX_UPLOAD_BYTES, MAX_UPLOAD_ROWS, MAX_UPLOAD_COLUMNS = 5 * 1024 * 1024, 10_000, 100
# What a pandas CSV reader takes for missing (public pandas documentation).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# What Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Columns of the top-risk list, fields of a triage record and of its reply, KPIs of a briefing, in order.
TOP_COLUMNS = (
    "ticket_id", "department", "issue_type", "priority", "agent", "status", "sla_status", "sentiment",
    "previous_contacts", "customer_rating", "escalation_risk_score", "customer_message",
)
TRIAGE_FIELDS = (
    "ticket_id", "risk_score", "risk_level", "sla_status", "sentiment", "action_level", "recommended_action",
    "routing_recommendation", "urgency", "business_reason", "business_impact", "risk_factors",
    "internal_manager_note", "customer_response_draft", "agent_trace",
)
KPIS = (
    "total_tickets", "open_tickets", "closed_tickets", "escalated_tickets", "sla_breach_rate",
    "avg_resolution_hours", "avg_customer_rating", "high_risk_tickets", "negative_sentiment_rate",
)
