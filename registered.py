"""The registered queries: each takes (spark, folder of parquet tables) and returns a frame over whole tables.

Lists are joined to text and structs flattened, so that results compare as plain values.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import schemas
from gaugeworks import wording as W
from gaugeworks.functions.text import join, redact, truncate
from gaugeworks.operators import (
    briefing, cleaning, matching, quality, questions, replies, risk, sla, spend, support, triage,
)
from gaugeworks.operators.measures import rollup
from gaugeworks.plans import reports
from gaugeworks.session import scratch_path
from gaugeworks.sources import keyword_store, scored_table, sinks, tables
from gaugeworks.sources.driver_views import AS_OF, SCHEMAS, DriverViews
from gaugeworks.sources.reply_log import ReplyLog
from gaugeworks.streaming import duplicates
from gaugeworks.streaming import tickets as ticket_stream

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: function(DriverViews(spark, folder), spark, folder)
    return function


def _scored(views: DriverViews) -> DataFrame:
    return risk.add_risk(views.tickets, AS_OF)


def _analyzed(views: DriverViews) -> DataFrame:
    return spend.analyze_costs(views.costs)


def _flat(frame: DataFrame) -> DataFrame:
    """Arrays of text as one text."""
    arrays = [n for n, kind in frame.dtypes if kind == "array<string>"]
    return frame.withColumns({n: join(F.col(n), "|") for n in arrays})


# --- SLA, risk, summaries ---


@query
def sla_by_department(v, spark, folder):
    return sla.sla_summary(sla.add_sla(v.tickets, AS_OF), "department")


@query
def sla_by_priority(v, spark, folder):
    return sla.sla_summary(sla.add_sla(v.tickets, AS_OF), "priority")


@query
def sql_breach_rate(v, spark, folder):
    return reports.breach_rate_by_department(v.tickets)


@query
def sql_issue_volume(v, spark, folder):
    return reports.volume_by_issue(v.tickets)


@query
def sql_agent_workload(v, spark, folder):
    return reports.workload_by_agent(v.tickets)


@query
def ticket_sentiment(v, spark, folder):
    return risk.add_sentiment(v.tickets).select("ticket_id", "customer_message", "sentiment")


@query
def document_sentiment(v, spark, folder):
    texts = v.resumes.withColumnRenamed("text", "customer_message")
    return risk.add_sentiment(texts).groupBy("sentiment").agg(F.count("*").alias("documents"))


@query
def scored_tickets(v, spark, folder):
    return _scored(v)


@query
def support_kpis(v, spark, folder):
    return support.kpis(_scored(v))


@query
def agent_performance(v, spark, folder):
    return support.agent_performance(_scored(v))


@query
def issue_summary(v, spark, folder):
    return support.issue_summary(_scored(v))


@query
def risk_histogram(v, spark, folder):
    return support.risk_histogram(_scored(v))


@query
def root_cause(v, spark, folder):
    return support.root_causes(_scored(v))


@query
def top_pain_points(v, spark, folder):
    return support.top_pain_points(_scored(v))


@query
def top_risk_tickets(v, spark, folder):
    return risk.top_risk_tickets(_scored(v))


@query
def customers_to_contact(v, spark, folder):
    return support.customers_to_contact(_scored(v))


@query
def overloaded_agents(v, spark, folder):
    return support.overloaded_agents(support.agent_performance(_scored(v), ordered=False))


# --- Cleaning and quality ---


@query
def us_times_sla(v, spark, folder):
    """Tickets whose times are written month first."""
    written = {c: F.date_format(c, "MM/dd/yyyy HH:mm") for c in ("created_at", "sla_due_at", "closed_at")}
    timed = sla.add_sla(v.tickets.withColumns(written), AS_OF, formats=("MM/dd/yyyy HH:mm",))
    return sla.sla_summary(timed, "department")


@query
def declared_table(v, spark, folder):
    """The declared ticket table, asked in SQL."""
    tables.register_tickets(v.tickets, "support_tickets")
    return spark.sql(
        "SELECT department, priority, count(*) AS tickets, count(closed_at) AS closed, sum(previous_contacts) AS contacts "
        "FROM support_tickets GROUP BY department, priority")


@query
def turn_sentiment(v, spark, folder):
    """Score and label of every turn of a conversation, between two fixed phrases that differ from turn to turn."""
    phrase = F.when(F.col("conv_id") % 3 == 0, "thanks, great ").when(F.col("conv_id") % 3 == 1, "angry, unhappy: ").otherwise("")
    turns = v.table("conversations").withColumn("customer_message", F.concat(phrase, F.coalesce("text", F.lit(""))))
    return risk.add_sentiment(turns).select("conv_id", "turn", "sentiment")


@query
def clean_tickets(v, spark, folder):
    return cleaning.clean_tickets(v.tickets_raw)


@query
def quality_report(v, spark, folder):
    return _flat(quality.quality_report(v.tickets_raw))


@query
def clean_quality_report(v, spark, folder):
    return _flat(quality.quality_report(cleaning.clean_tickets(v.tickets_raw)))


@query
def duplicate_rows(v, spark, folder):
    return quality.duplicate_rows(v.tickets_raw).select("ticket_id", "customer_id", "created_at", "later_occurrences")


@query
def cleaned_sla_by_department(v, spark, folder):
    cleaned = cleaning.clean_tickets(v.tickets_raw)
    return sla.sla_summary(sla.add_sla(cleaned, AS_OF, lenient=True), "department")


# --- Triage and briefing ---


@query
def ticket_triage(v, spark, folder):
    return _flat(triage.triage(_scored(v)))


@query
def ticket_actions(v, spark, folder):
    made = triage.triage(_scored(v))
    return made.groupBy("action_level", "urgency", "business_impact").agg(F.count("*").alias("tickets"))


@query
def risk_factors(v, spark, folder):
    made = triage.triage(_scored(v)).select(F.explode_outer("risk_factors").alias("risk_factor"))
    return made.groupBy("risk_factor").agg(F.count("*").alias("tickets"))


@query
def recommendations(v, spark, folder):
    return briefing.recommendations(_scored(v))


def _flat_briefing(brief: DataFrame, report) -> DataFrame:
    return _flat(
        brief.select(
            "kpis.*",
            "briefing_sections.*",
            "recommended_actions",
            F.transform("top_high_risk_tickets", lambda t: t["ticket_id"]).alias("top_tickets"),
            F.transform(
                "top_pain_points", lambda p: F.concat_ws("/", p["department"], p["issue_type"])
            ).alias("pain_points"),
            "overloaded_agents",
            "agent_trace",
            *report,
        )
    )


@query
def daily_briefing(v, spark, folder):
    brief = briefing.briefing(_scored(v))
    return _flat_briefing(brief, [briefing.briefing_text(brief).alias("report")])


@query
def findings(v, spark, folder):
    record = briefing.run_findings(v.tickets, "What is most urgent?", AS_OF).record
    return _flat(
        record.select(
            "status", "mode", "agent_trace", "user_question", "findings.kpis.*",
            F.size("findings.top_high_risk_tickets").alias("top_tickets"),
            F.size("findings.top_pain_points").alias("pain_points"),
            "manager_briefing", "recommended_actions",
        )
    )


@query
def dataset_summary(v, spark, folder):
    return support.dataset_summary(_scored(v), W.SUPPORT_SUMMARY)


@query
def support_questions(v, spark, folder):
    summary = support.dataset_summary(_scored(v), W.SUPPORT_SUMMARY).select("summary").scalar()
    return questions.ask(v.questions, summary, W.SUPPORT_QUESTION, W.SUPPORT_ANSWER)


@query
def cost_questions(v, spark, folder):
    rolled = spend.cost_rollup(_analyzed(v), "department", "vendor")
    summary = spend.cost_summary(rolled).select("summary").scalar()
    return questions.ask(v.questions, summary, W.COST_QUESTION, W.COST_ANSWER)


@query
def answered_questions(v, spark, folder):
    summary = support.dataset_summary(_scored(v), W.SUPPORT_SUMMARY).select("summary").scalar()
    asked = questions.ask(v.questions, summary, W.SUPPORT_QUESTION, W.SUPPORT_ANSWER)
    # The assistant's turn after a question is its reply.
    turns = v.table("conversations").where("role = 'assistant'")
    given = turns.select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("question_id"), F.col("text").alias("reply"))
    return questions.answer(asked, given)


# --- Spend ---


@query
def cost_analysis(v, spark, folder):
    return _analyzed(v)


@query
def cost_totals(v, spark, folder):
    return spend.cost_totals(_analyzed(v))


@query
def cost_by_month(v, spark, folder):
    return spend.cost_by_date(_analyzed(v))


@query
def cost_by_category_risk(v, spark, folder):
    return spend.variance_by_category(_analyzed(v))


@query
def cost_by_department(v, spark, folder):
    return spend.cost_by_department(_analyzed(v))


@query
def vendor_share(v, spark, folder):
    return spend.vendor_share(_analyzed(v))


@query
def cost_report(v, spark, folder):
    return spend.cost_report(spend.cost_rollup(_analyzed(v), "department", "vendor"))


@query
def roi_by_department(v, spark, folder):
    costs = spend.cost_by_department(_analyzed(v)).select("department", "actual_amount")
    return spend.roi(costs, "actual_amount")


# --- Text and matching ---


@query
def redacted_documents(v, spark, folder):
    return v.resumes.select("resume_id", redact(F.col("text")).alias("redacted"))


@query
def truncated_documents(v, spark, folder):
    return v.resumes.select("resume_id", truncate(F.col("text"), C.MAX_TEXT_CHARS).alias("truncated"))


@query
def keyword_counts(v, spark, folder):
    return matching.keyword_counts(v.resumes, "resume_id", long_chars=matching.LONG_TEXT_CHARS)


@query
def jd_top_keywords(v, spark, folder):
    return matching.ranked_keywords(v.jds, "jd_id")


@query
def resume_top_keywords(v, spark, folder):
    return matching.ranked_keywords(v.resumes, "resume_id")


def _matches(v: DriverViews, **options) -> DataFrame:
    return matching.match_pairs(v.applications, matching.non_blank(v.resumes), matching.non_blank(v.jds), **options)


@query
def resume_match(v, spark, folder):
    return _flat(_matches(v))


@query
def stored_match(v, spark, folder):
    """The pairs in two rounds against keyword tables that are stored once."""
    path = scratch_path(spark, "keywords")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    wanted = keyword_store.store(matching.job_keywords(matching.non_blank(v.jds)), f"{name}_jobs", f"{path}/jobs", "jd_id")
    offered = keyword_store.store(matching.resume_keywords(matching.non_blank(v.resumes)), f"{name}_resumes", f"{path}/resumes", "resume_id")
    first = v.applications.where("jd_id <= resume_id")
    second = v.applications.where("jd_id > resume_id")
    return _flat(matching.match_stored(first, wanted, offered).unionByName(matching.match_stored(second, wanted, offered)))


@query
def keyword_coverage(v, spark, folder):
    return matching.keyword_coverage(_matches(v))


@query
def candidate_feedback(v, spark, folder):
    return _flat(matching.candidate_feedback(_matches(v)))


@query
def validated_feedback(v, spark, folder):
    return _flat(matching.candidate_feedback(_matches(v, replies=v.feedback_replies)))


@query
def candidate_report(v, spark, folder):
    return matching.candidate_report(_matches(v))


@query
def feedback_report(v, spark, folder):
    return matching.feedback_report(matching.candidate_feedback(_matches(v, replies=v.feedback_replies)))


@query
def candidate_prompts(v, spark, folder):
    return matching.candidate_prompts(_matches(v, with_texts=True))


# --- Prompts and replies ---


@query
def triage_prompts(v, spark, folder):
    return triage.triage_prompts(_scored(v))


@query
def briefing_prompt(v, spark, folder):
    return briefing.briefing_prompt(briefing.briefing(_scored(v)))


@query
def parsed_replies(v, spark, folder):
    return _flat(replies.parsed_replies(v.replies))


@query
def merged_triage(v, spark, folder):
    return _flat(replies.merge_triage(_scored(v), v.replies))


def _plain_answer(prompts: list[str]) -> list[str]:
    """A stand-in for a model that answers the same prompt alike."""
    return [f'{{"risk_score": {len(p) % 101}, "urgency": "{p[-1:]}"}}' for p in prompts]


@query
def logged_replies(v, spark, folder):
    """All prompts asked through a reply log, in two parts, by a run that is repeated; `asked` counts a prompt's replies."""
    log = ReplyLog(spark, scratch_path(spark, "replies"))
    prompts = triage.triage_prompts(_scored(v))
    log.ask(prompts, _plain_answer, parts=2)
    if log.ask(prompts, _plain_answer):
        raise RuntimeError("a prompt that has a reply was asked again")
    asked = log.replies().groupBy("prompt_hash").agg(F.max("reply").alias("reply"), F.count(F.lit(1)).alias("asked"))
    hashed = prompts.select("ticket_id", F.sha2("prompt", 256).alias("prompt_hash"))
    return hashed.join(asked, "prompt_hash", "left").select("ticket_id", "reply", "asked")


@query
def ticket_lookup(v, spark, folder):
    """The scored tickets that have a reply, from a stored table."""
    path = scratch_path(spark, "scored-table")
    scored_table.store(_scored(v), path, buckets=4, period="yyyy")
    return scored_table.by_ids(spark, path, v.replies, buckets=4)


@query
def merged_briefing(v, spark, folder):
    reply = F.lit('{"briefing_sections": {"sla_risk": "Look at SLA."}, "agent_trace": ["read"]}')
    merged = briefing.merge_briefing(briefing.briefing(_scored(v)), reply)
    return _flat_briefing(merged, ["mode"])


# --- Sources, sinks, streams ---


@query
def csv_roundtrip(v, spark, folder):
    path = scratch_path(spark, "tickets") + ".csv"
    sinks.write_csv(v.tickets, path)
    read = tables.load_tickets(spark, path, label="roundtrip")
    return tables.cast_to(read, schemas.TICKETS)


@query
def report_roundtrip(v, spark, folder):
    path = scratch_path(spark, "cost-report")
    sinks.write_report(cost_report(v, spark, folder), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def guarded_csv(v, spark, folder):
    path = scratch_path(spark, "volumes") + ".csv"
    counted = rollup(_scored(v), "department", "issue_type", "agent")
    sinks.write_csv(counted.select("department", "issue_type", "agent", "m_rows"), path)
    # The view has 5 departments, 8 issues and 8 agents, whatever the number of orders.
    read = tables.read_guarded_csv(spark, path, max_rows=5 * 8 * 8)
    return read.select("department", "issue_type", "agent", F.col("m_rows").cast("bigint").alias("tickets"))


def _live(spark: SparkSession, folder: str) -> DriverViews:
    orders = spark.readStream.schema(SCHEMAS["orders"]).option("pathGlobFilter", "orders.parquet").parquet(folder)
    return DriverViews(spark, folder, orders=orders)


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    return risk.add_risk(_live(spark, folder).tickets, AS_OF)


@query
def stream_scored_tickets(v, spark, folder):
    path = scratch_path(spark, "scored")
    ticket_stream.append_to(_streamed(spark, folder), path, path + "-checkpoint").awaitTermination()
    return spark.read.parquet(path)


@query
def stream_breach_windows(v, spark, folder):
    path = scratch_path(spark, "windows")
    # The orders come in no order of time: the delay covers all of their years.
    windows = ticket_stream.breach_windows(_streamed(spark, folder), delay="4000 days")
    ticket_stream.upsert_to(windows, path, path + "-checkpoint", compact_every=1).awaitTermination()
    return ticket_stream.latest_windows(spark, path)


@query
def stream_duplicate_rows(v, spark, folder):
    """`duplicate_rows` of a stream of raw tickets; all ids are remembered."""
    path = scratch_path(spark, "later-rows")
    raw, years = _live(spark, folder).tickets_raw, timedelta(days=4000)
    later = duplicates.later_rows(raw, F.col("created_at").try_cast("timestamp_ntz"), delay="4000 days", keep=years)
    ticket_stream.append_to(later, path, path + "-checkpoint").awaitTermination()
    written = spark.read.schema(later.schema).parquet(path)
    counted = written.groupBy(*written.columns).agg(F.count(F.lit(1)).alias("later_occurrences"))
    return counted.select("ticket_id", "customer_id", "created_at", "later_occurrences")
