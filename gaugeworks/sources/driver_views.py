"""The library's input tables as views over a folder of order, line item, document and conversation tables.

For tests, the bench and the registered queries. As all times lie around 1998, that is the as-of date to use.
"""

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(1998, 1, 1)

TICKETS = """
SELECT concat('TKT-', lpad(cast(o.o_orderkey AS VARCHAR(20)), 8, '0')) AS ticket_id,
       concat('CUST-', cast(o.o_custkey AS VARCHAR(20))) AS customer_id,
       r.r_name AS department,
       concat('ISSUE-', cast(o.o_orderkey % 8 AS VARCHAR(20))) AS issue_type,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unspecified' END AS priority,
       concat('AGENT-', cast(o.o_custkey % 8 AS VARCHAR(20))) AS agent,
       CASE (o.o_orderkey % 4) WHEN 0 THEN 'Email' WHEN 1 THEN 'Chat' WHEN 2 THEN 'Phone' ELSE 'Web Form' END AS channel,
       o.o_orderdate AS created_at,
       o.o_orderdate + INTERVAL '1' HOUR * CASE o.o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 24
            WHEN '3-MEDIUM' THEN 48 ELSE 72 END AS sla_due_at,
       CASE WHEN o.o_orderstatus <> 'O'
            THEN o.o_orderdate + INTERVAL '1' HOUR * cast(2 + (o.o_orderkey * 37) % 95 AS INT) END AS closed_at,
       CASE o.o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Escalated' END AS status,
       CASE WHEN o.o_orderstatus <> 'O' THEN cast(2 + (o.o_orderkey * 37) % 95 AS DOUBLE) END AS resolution_hours,
       cast((o.o_orderkey * 13) % 6 AS INT) AS previous_contacts,
       CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE
       CASE ((o.o_orderkey * 7) % 11)
         WHEN 0 THEN 'Nobody answered and I am tired of waiting.'
         WHEN 1 THEN 'Very frustrating, fix this immediately.'
         WHEN 2 THEN 'Please cancel my plan.'
         WHEN 3 THEN 'Thanks for such a quick fix.'
         WHEN 4 THEN 'I appreciate it but I am unhappy and waiting.'
         WHEN 5 THEN 'All went well.'
         WHEN 6 THEN 'Thank you, but the fault is affecting my team.'
         ELSE 'Any news on my request?' END END AS customer_message,
       CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE cast(1 + (o.o_orderkey * 11) % 5 AS INT) END AS customer_rating
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

TICKETS_RAW = """
SELECT CASE WHEN customer_id LIKE '%97' THEN 'TKT-DUP' ELSE concat(' ', ticket_id, ' ') END AS ticket_id,
       customer_id, department, issue_type,
       CASE WHEN customer_id LIKE '%13' THEN NULL ELSE concat(priority, ' ') END AS priority,
       agent, channel,
       CASE WHEN customer_id LIKE '%41' THEN 'not-a-date' ELSE cast(created_at AS VARCHAR(30)) END AS created_at,
       cast(sla_due_at AS VARCHAR(30)) AS sla_due_at,
       CASE WHEN customer_id LIKE '%43' THEN 'soon' ELSE cast(closed_at AS VARCHAR(30)) END AS closed_at,
       CASE WHEN customer_id LIKE '%29' THEN 'closed' ELSE status END AS status,
       CASE WHEN customer_id LIKE '%31' THEN 'many' ELSE cast(previous_contacts AS VARCHAR(10)) END AS previous_contacts,
       CASE WHEN customer_id LIKE '%37' THEN '   ' ELSE customer_message END AS customer_message,
       CASE WHEN customer_id LIKE '%19' THEN '2.7' ELSE cast(customer_rating AS VARCHAR(10)) END AS customer_rating
FROM tickets
"""

COSTS = """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS date, r.r_name AS department, p.p_type AS cost_category,
       s.s_name AS vendor,
       CASE WHEN l.l_orderkey % 997 = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(floor(CAST(round(l.l_extendedprice * 100) AS BIGINT) * (85 + 5 * (l.l_partkey % 5)) / 10000)
                      AS BIGINT) END AS budget_amount,
       CAST(floor(CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT))
                  * (100 + CAST(round(l.l_tax * 100) AS BIGINT)) / 1000000) AS BIGINT) AS actual_amount
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

RESUMES = "SELECT doc_id AS resume_id, text FROM documents"
JDS = "SELECT item_id AS jd_id, text FROM benchmark"

# Every resume goes to two jobs (or twice to one); item ids run from 0 without gaps.
APPLICATIONS = """
SELECT doc_id AS resume_id, doc_id % (SELECT count(*) FROM benchmark) AS jd_id FROM documents
UNION ALL
SELECT doc_id AS resume_id, (doc_id * 7 + 3) % (SELECT count(*) FROM benchmark) AS jd_id FROM documents
"""

REPLIES = """
SELECT ticket_id,
       CASE WHEN previous_contacts = 0 THEN concat('```json', chr(10), '{"risk_score": 91, "risk_level": "Critical", "risk_factors": ["a", "b"]}', chr(10), '```')
            WHEN previous_contacts = 1 THEN concat('Result: {"urgency": "Low",', chr(10), '"agent_trace": ["read"]} end')
            WHEN previous_contacts = 2 THEN 'no object here'
            WHEN previous_contacts = 3 THEN '{"risk_score": '
            WHEN previous_contacts = 4 THEN ''
            ELSE NULL END AS reply
FROM tickets
"""

FEEDBACK_REPLIES = """
SELECT resume_id, jd_id,
       CASE resume_id % 4
         WHEN 0 THEN '{"overall_feedback": "  Good fit  ", "strengths": ["sql", " ", " reports "], "gaps": "none"}'
         WHEN 1 THEN '{"overall_feedback": null, "interview_questions": ["Why us?"], "agent_trace": []}'
         WHEN 2 THEN 'no object here' END AS reply
FROM applications
"""

QUESTIONS = """
SELECT concat(cast(conv_id AS VARCHAR(20)), '-', cast(turn AS VARCHAR(20))) AS question_id, text AS question
FROM conversations WHERE role = 'user'
"""

VIEWS = {
    "tickets": TICKETS, "tickets_raw": TICKETS_RAW, "costs": COSTS, "resumes": RESUMES, "jds": JDS,
    "applications": APPLICATIONS, "replies": REPLIES, "feedback_replies": FEEDBACK_REPLIES, "questions": QUESTIONS,
}


# The columns the views use. A declared schema saves the job that reads it from the files.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_extendedprice DOUBLE, l_discount DOUBLE, "
                "l_tax DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

class DriverViews:
    """The views over one folder: `DriverViews(spark, folder).tickets` and so on.

    `tables` replaces tables of the folder by frames, streaming ones included.
    """

    def __init__(self, spark: SparkSession, folder: str, **tables: DataFrame):
        self._spark, self._folder, self._tables = spark, folder, tables

    def table(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        return self._spark.read.schema(SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source = r"\b(FROM|JOIN) (\w+)"
        sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
        used = {m[1] for m in re.findall(source, sql)}
        frames = {u: getattr(self, u) if u in VIEWS else self.table(u) for u in used}
        return self._spark.sql(re.sub(source, r"\1 {\2}", sql), **frames)
