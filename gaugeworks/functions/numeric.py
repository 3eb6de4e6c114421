"""Number columns: rounding, rates, bands, lookups."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.constants import UNBANDED


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Round as numpy does: scale, round halves to even, scale back (Spark's `round` takes halves up)."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) if digits else F.rint(value)


def ratio(part: Column, whole: Column) -> Column:
    """`part / whole` as DOUBLE, null where `whole` is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_half_even(ratio(part, whole) * 100.0, digits)


def band(value: Column, edges, labels, outside: str = UNBANDED) -> Column:
    """The label of the half-open interval (low, high] that holds `value`; `outside` for none and for null."""
    chain = F
    for low, high, label in zip(edges, edges[1:], labels):
        chain = chain.when((value > low) & (value <= high), F.lit(label))
    return chain.otherwise(F.lit(outside))


def points(value: Column, table: dict) -> Column:
    """The points a label is worth; 0 for a label without an entry."""
    chain = F
    for label, worth in table.items():
        chain = chain.when(value == label, F.lit(worth))
    return chain.otherwise(F.lit(0))


def decimal_number(value: Column) -> Column:
    """Decimal text or a number to DOUBLE; null for anything else, also for the forms `2d` and `0x1p3` a cast accepts."""
    other = F.translate(value.cast("string"), "0123456789+-.eE \t\r\n", "")
    return F.when(other == "", value.try_cast("double"))


def lenient_int(value: Column, default: int) -> Column:
    """Number or decimal text to INT, fraction cut off; `default` for null and for anything else."""
    return F.coalesce(decimal_number(value).try_cast("int"), F.lit(default))
