"""Data quality of a raw ticket table."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks import constants as C
from gaugeworks.functions.dates import parse_time
from gaugeworks.functions.text import fill, is_blank, present
from gaugeworks.operators.skew import ROWS_PER_PART, attach, salts


def _missing(frame: DataFrame) -> Column:
    cells = []
    for field in frame.schema:
        empty = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            empty = empty | F.isnan(field.name)
        cells.append(empty.cast("int"))
    return F.coalesce(F.sum(reduce(add, cells)), F.lit(0).cast("bigint"))


def _outside(name: str, domain) -> Column:
    return F.count_if(~F.coalesce(F.col(name).isin(*domain), F.lit(False)))


def _bad_dates(frame: DataFrame, formats: tuple[str, ...]) -> Column:
    bad = F.lit(0).cast("bigint")
    for name in ("created_at", "sla_due_at", "closed_at"):
        if name in frame.columns:
            unreadable = parse_time(F.col(name), True, formats).isNull()
            # An open ticket has no closing time.
            bad = bad + F.count_if(unreadable & F.col(name).isNotNull() if name == "closed_at" else unreadable)
    return bad


def duplicate_count(frame: DataFrame, key: str = "ticket_id") -> DataFrame:
    """One row: occurrences after the first of each id; nulls count as one id."""
    per_id = frame.groupBy(key).agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("duplicate_ticket_count"))


def quality_report(frame: DataFrame, formats: tuple[str, ...] = ()) -> DataFrame:
    """One row: the counters, the score out of 100 and the list of issues. Times are good in ISO form or one of `formats`.

    Two passes: all counters but one in a global aggregate (no shuffle of rows), and the ids alone for duplicates.
    """
    has = set(frame.columns)
    zero = F.lit(0).cast("bigint")
    counters = frame.agg(
        F.count("*").alias("total_rows"),
        _missing(frame).alias("missing_value_total"),
        (_outside("priority", C.PRIORITIES) if "priority" in has else F.max(zero)).alias("invalid_priority_count"),
        (_outside("status", C.STATUSES) if "status" in has else F.max(zero)).alias("invalid_status_count"),
        _bad_dates(frame, formats).alias("invalid_date_count"),
        (F.count_if(is_blank(F.col("customer_message"))) if "customer_message" in has else F.max(zero)).alias(
            "missing_message_count"
        ),
    ).withColumn(
        "duplicate_ticket_count", duplicate_count(frame).scalar() if "ticket_id" in has else zero
    )
    penalties = [F.least(F.col(name) * worth, F.lit(cap)) for name, _, worth, cap in C.QUALITY_RULES]
    penalties.append(
        F.least(F.expr("missing_value_total div greatest(total_rows, 1)"), F.lit(C.MISSING_VALUES_CAP))
    )
    found = [(F.col(name) > 0, fill(line, n=F.col(name))) for name, line, _, _ in C.QUALITY_RULES]
    found.append((F.col("missing_value_total") > 0, fill(C.MISSING_VALUES_LINE, n=F.col("missing_value_total"))))
    issues = present(*found)
    return counters.select(
        "total_rows",
        F.lit(len(frame.columns)).alias("total_columns"),
        "missing_value_total",
        *[name for name, *_ in C.QUALITY_RULES],
        F.greatest(F.lit(0), 100 - reduce(add, penalties)).cast("int").alias("quality_score"),
        F.when(F.size(issues) > 0, issues).otherwise(F.array(F.lit(C.NO_ISSUES_LINE))).alias("issues"),
    )


def duplicate_rows(
    frame: DataFrame, key: str = "ticket_id", order_by: tuple[str, ...] = ("created_at",), rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Rows that repeat an id, with `later_occurrences`: how many of their copies come after the id's first row.

    Rows are ordered by `order_by`, then by their other columns. Ids are counted first; whether the repeated ones are sent to
    the rows or both are shuffled is left to adaptive execution. Copies are counted and first rows found by combinable
    aggregates, and an id of more than `rows_per_part` rows is spread when the two meet, so no task holds all its rows.
    """
    rest = [c for c in frame.columns if c != key and c not in order_by]
    # Null is an id like any other here, so it gets a text to join on.
    id_text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    repeated = frame.groupBy(id_text.alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1")
    hot = salts(repeated, "_key", "_rows", rows_per_part)
    rows = frame.withColumn("_key", id_text).join(repeated, "_key", "left_semi").drop("_key")
    copies = rows.groupBy(*frame.columns).agg(F.count("*").alias("_copies")).withColumn("_key", id_text)
    row = F.struct(*order_by, *rest)
    firsts = copies.groupBy("_key").agg(F.min(row).alias("_first"))
    later = F.col("_copies") - F.when(row.eqNullSafe(F.col("_first")), 1).otherwise(0)
    joined = attach(copies, firsts, "_key", spread_by=[*order_by, *rest], hot=hot, how="inner")
    return joined.select(*frame.columns, later.alias("later_occurrences")).where("later_occurrences > 0")
