"""Sentiment, risk score and risk level per ticket; the riskiest tickets."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.functions.numeric import band, points
from gaugeworks.functions.sentiment import label_of_score, sentiment_score
from gaugeworks.operators.sla import add_sla

TOP_COLUMNS = C.TOP_COLUMNS


def add_sentiment(frame: DataFrame) -> DataFrame:
    scored = frame.withColumn("_sentiment_score", sentiment_score(F.col("customer_message")))
    return scored.withColumn("sentiment", label_of_score(F.col("_sentiment_score"))).drop("_sentiment_score")


def add_risk(
    frame: DataFrame, as_of: datetime = C.AS_OF, at_risk_hours: float | None = None, lenient: bool = False,
    formats: tuple[str, ...] = (),
) -> DataFrame:
    """SLA columns, sentiment, escalation_risk_score (0 to 100) and risk_level. Row-local: no shuffle, no Python."""
    frame = add_sentiment(add_sla(frame, as_of, at_risk_hours, lenient, formats))
    contacts = F.coalesce(F.col("previous_contacts"), F.lit(0)) * C.CONTACT_POINTS
    score = (
        points(F.col("priority"), C.PRIORITY_POINTS)
        + points(F.col("sentiment"), C.SENTIMENT_POINTS)
        + points(F.col("sla_status"), C.SLA_POINTS)
        + F.least(contacts, F.lit(C.CONTACT_POINTS_CAP))
        + F.when(F.col("status") == "Escalated", C.ESCALATED_POINTS).otherwise(0)
        + F.when(F.col("customer_rating") <= C.LOW_RATING, C.LOW_RATING_POINTS).otherwise(0)
    )
    frame = frame.withColumn("escalation_risk_score", F.least(score, F.lit(C.MAX_SCORE)).cast("int"))
    return frame.withColumn("risk_level", band(F.col("escalation_risk_score"), *C.RISK_BAND))


def is_scored(frame: DataFrame) -> bool:
    return {"escalation_risk_score", "risk_level"} <= set(frame.columns)


def ensure_scored(frame: DataFrame, as_of: datetime = C.AS_OF) -> DataFrame:
    return frame if is_scored(frame) else add_risk(frame, as_of)


def top_risk_tickets(scored: DataFrame, n: int = 20) -> DataFrame:
    """The n tickets with the highest score (of any level), ties by id: a distributed top-k, not a full sort."""
    return scored.select(*TOP_COLUMNS).orderBy(F.desc("escalation_risk_score"), "ticket_id").limit(n)
