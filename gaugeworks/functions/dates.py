"""Timestamps without a zone."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def parse_time(value: Column, lenient: bool = False, formats: tuple[str, ...] = ()) -> Column:
    """To TIMESTAMP_NTZ. `formats` are tried after ISO forms; text of no known form raises, or is null if `lenient`."""
    if not lenient and not formats:
        return value.cast("timestamp_ntz")
    parsed = [value.try_cast("timestamp_ntz")]
    parsed += [F.try_to_timestamp(value.cast("string"), F.lit(f)).cast("timestamp_ntz") for f in formats]
    # The cast comes last: it is reached only by what no form could read, and raises.
    return F.coalesce(*parsed, *([] if lenient else [value.cast("timestamp_ntz")]))


def parse_date(value: Column, formats: tuple[str, ...] = ()) -> Column:
    """To DATE; null for text of no known form."""
    text = value.cast("string")
    return F.coalesce(value.try_cast("date"), *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def hours_between(start: Column, end: Column) -> Column:
    """Exact to the microsecond; null if either is null."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def literal_time(value: datetime) -> Column:
    """A naive datetime as it reads; `lit` alone would take it for an instant in the zone of the machine."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def to_instant(value: Column) -> Column:
    """TIMESTAMP_NTZ, read as UTC, to TIMESTAMP; independent of the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", literal_time(EPOCH), value))


def from_instant(value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(value), literal_time(EPOCH))
