"""Budget variance, savings and their rollups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.functions.dates import parse_date
from gaugeworks.functions.numeric import band, percent, ratio, round_half_even
from gaugeworks.functions.text import fill, lines, whole_number
from gaugeworks.operators.support import first_by

AMOUNTS = ("budget_amount", "actual_amount", "variance", "savings_opportunity")


def analyze_costs(frame: DataFrame, unbanded: str = C.UNBANDED, formats: tuple[str, ...] = ()) -> DataFrame:
    """Dates are ISO text or of one of the `formats`. Add variance, variance_pct, savings_opportunity and risk_level. A zero budget has no percentage and no band."""
    variance = F.col("actual_amount") - F.col("budget_amount")
    frame = frame.withColumns({"date": parse_date(F.col("date"), formats), "variance": variance})
    saving = F.greatest(F.col("variance").cast("double") * C.SAVINGS_FRACTION, F.lit(0.0))
    frame = frame.withColumns(
        {
            "variance_pct": percent(F.col("variance"), F.col("budget_amount"), 1),
            # greatest() skips nulls; a missing variance must stay missing.
            "savings_opportunity": F.when(F.col("variance").isNotNull(), round_half_even(saving)),
        }
    )
    return frame.withColumn("risk_level", band(F.col("variance_pct"), *C.VARIANCE_BAND, outside=unbanded))


def _sum(name: str) -> Column:
    return F.sum(name).alias(name)


def cost_rollup(analyzed: DataFrame, *keys: str) -> DataFrame:
    """The four amounts summed per combination of keys; sums of it are the totals."""
    return analyzed.groupBy(*keys).agg(*[_sum(name) for name in AMOUNTS])


def cost_totals(analyzed: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return analyzed.agg(
        F.coalesce(F.sum("actual_amount"), zero).alias("total_spend"),
        F.coalesce(F.sum("budget_amount"), zero).alias("total_budget"),
        F.coalesce(F.sum("savings_opportunity"), F.lit(0.0)).alias("savings"),
    ).select("total_spend", "total_budget", (F.col("total_spend") - F.col("total_budget")).alias("variance"), "savings")


def cost_by_date(analyzed: DataFrame) -> DataFrame:
    dated = analyzed.where(F.col("date").isNotNull())
    return dated.groupBy("date").agg(_sum("budget_amount"), _sum("actual_amount")).orderBy("date")


def variance_by_category(analyzed: DataFrame) -> DataFrame:
    grouped = analyzed.where(F.col("cost_category").isNotNull()).groupBy("cost_category", "risk_level")
    return grouped.agg(_sum("variance")).orderBy("cost_category", "risk_level")


def cost_by_department(analyzed: DataFrame) -> DataFrame:
    return cost_rollup(analyzed.where(F.col("department").isNotNull()), "department").orderBy("department")


def vendor_share(analyzed: DataFrame) -> DataFrame:
    """Spend per vendor and its share of the whole. The whole is a subquery over the same shuffled sums, no window."""
    spend = analyzed.where(F.col("vendor").isNotNull()).groupBy("vendor").agg(_sum("actual_amount"))
    whole = spend.agg(F.sum("actual_amount")).scalar()
    return spend.withColumn("share", ratio(F.col("actual_amount"), whole)).orderBy(F.desc("actual_amount"), "vendor")


def _with_leaders(rolled: DataFrame) -> DataFrame:
    def leader(key: str, amount: str) -> Column:
        sums = rolled.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(amount).alias("amount"))
        return F.coalesce(first_by(sums, -F.col("amount"), F.col(key), take=[key])[key], F.lit("N/A"))

    return cost_totals(rolled).withColumns(
        {"top_department": leader("department", "variance"), "top_vendor": leader("vendor", "actual_amount")}
    )


def _slots() -> dict[str, Column]:
    return dict(
        actual=whole_number(F.col("total_spend")),
        budget=whole_number(F.col("total_budget")),
        variance=whole_number(F.col("variance")),
        savings=whole_number(F.col("savings")),
        department=F.col("top_department"),
        vendor=F.col("top_vendor"),
    )


def cost_summary(rolled: DataFrame) -> DataFrame:
    """One row: totals, leaders and one sentence. Takes analysed costs or a `cost_rollup` by department and vendor."""
    return _with_leaders(rolled).withColumn("summary", fill(W.COST_SUMMARY, **_slots()))


def cost_report(rolled: DataFrame) -> DataFrame:
    """One row `report`, input as for `cost_summary`."""
    body = [fill(line, **_slots()) if line else F.lit("") for line in W.COST_REPORT_LINES]
    return _with_leaders(rolled).select(lines(F.lit(W.COST_REPORT_HEADING), F.lit(""), *body).alias("report"))


def roi(frame: DataFrame, cost: str, avoidable_pct: float = 8, hours_saved: float = 20) -> DataFrame:
    """Add estimated savings, labour value and their sum to rows with a monthly cost."""
    savings = F.col(cost).cast("double") * F.lit(float(avoidable_pct)) / 100.0
    labour = F.lit(float(hours_saved * C.HOURLY_VALUE))
    return frame.withColumns(
        {"monthly_savings": savings, "labor_savings": labour, "total_value": savings + labour}
    )
