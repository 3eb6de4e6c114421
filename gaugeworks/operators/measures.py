"""Additive ticket measures, the common ground of all summaries.

A summary sums measures per group and turns the sums into rates and averages. Sums of sums are sums, so a summary takes
the scored tickets themselves or a `rollup` of them: roll up once (one scan, partial aggregation, one small shuffle) and
derive every coarser summary from that.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import percent, ratio, round_half_even
from gaugeworks.functions.sentiment import is_negative

KEYS = ("department", "issue_type", "agent", "priority", "risk_level")
PREFIX = "m_"
MICROS_PER_HOUR = 3.6e9
# What a measure is divided by to be a value again.
UNITS = {"hours": MICROS_PER_HOUR}


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _definitions(has) -> dict[str, Column]:
    made = {"rows": F.lit(1), "ids": F.col("ticket_id").isNotNull().cast("int")}
    if "status" in has:
        made |= {name.lower(): _flag(F.col("status") == name) for name in ("Open", "Closed", "Escalated")}
    if "sla_breached" in has:
        made["breached"] = _flag(F.col("sla_breached"))
    if "actual_resolution_hours" in has:
        # Whole microseconds: decimal sums do not depend on the order of the rows, sums of doubles do.
        made["hours"] = F.round(F.col("actual_resolution_hours") * MICROS_PER_HOUR).cast("decimal(20,0)")
        made["hours_n"] = F.col("actual_resolution_hours").isNotNull().cast("int")
    if "customer_rating" in has:
        made["rating"] = F.col("customer_rating").cast("bigint")
        made["rating_n"] = F.col("customer_rating").isNotNull().cast("int")
    if "escalation_risk_score" in has:
        made["score"] = F.col("escalation_risk_score")
        made["high"] = _flag(F.col("risk_level") == "High")
    if "sentiment" in has:
        made["negative"] = _flag(is_negative(F.col("sentiment")))
    return made


def as_measures(frame: DataFrame) -> DataFrame:
    """Key and measure columns of a ticket frame; a rollup passes through."""
    if PREFIX + "rows" in frame.columns:
        return frame
    has = set(frame.columns)
    return frame.select(
        *[k for k in KEYS if k in has], *[m.alias(PREFIX + name) for name, m in _definitions(has).items()]
    )


def rollup(frame: DataFrame, *keys: str) -> DataFrame:
    """Measures summed per combination of keys; null keys form groups of their own, for the totals."""
    measured = as_measures(frame)
    return measured.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measured.columns if c.startswith(PREFIX)])


# `of` is F.sum in an aggregate, and F.col where each row holds its sums already.


def total(name: str, of=F.sum) -> Column:
    return F.coalesce(of(PREFIX + name), F.lit(0).cast("bigint"))


def rate(part: str, whole: str, of=F.sum) -> Column:
    return percent(total(part, of), total(whole, of))


def average(value: str, count: str, of=F.sum) -> Column:
    summed = of(PREFIX + value).cast("double") / UNITS.get(value, 1.0)
    return round_half_even(ratio(summed, total(count, of)), 2)


def summarise(frame: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """Group by the given keys, without groups that have a null key."""
    measured = as_measures(frame)
    for key in by:
        measured = measured.where(F.col(key).isNotNull())
    return measured.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])
