"""Cleaning and column checks."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.functions.numeric import lenient_int
from gaugeworks.functions.text import strip


@dataclass(frozen=True)
class ColumnCheck:
    passed: bool
    missing: list[str]
    required: list[str]
    present: list[str]


def check_columns(frame: DataFrame, required=C.REQUIRED_TICKET_COLUMNS) -> ColumnCheck:
    """Which required columns are absent, in required order. Reads the schema only."""
    missing = [name for name in required if name not in frame.columns]
    return ColumnCheck(not missing, missing, list(required), list(frame.columns))


def check_cost_columns(frame: DataFrame) -> ColumnCheck:
    """As `check_columns`, missing names in alphabetical order."""
    check = check_columns(frame, C.REQUIRED_COST_COLUMNS)
    return ColumnCheck(check.passed, sorted(check.missing), check.required, check.present)


def require_columns(frame: DataFrame, required=C.REQUIRED_TICKET_COLUMNS) -> DataFrame:
    check = check_columns(frame, required)
    if not check.passed:
        raise ValueError(f"missing columns: {', '.join(check.missing)}")
    return frame


def strip_column_names(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[name.strip() for name in frame.columns])


def clean_tickets(frame: DataFrame) -> DataFrame:
    """Strip column names and text, make the counters whole numbers. Nulls in text stay null."""
    frame = strip_column_names(frame)
    cleaned = {name: strip(F.col(name).cast("string")) for name in C.TRIMMED_COLUMNS if name in frame.columns}
    types = dict(frame.dtypes)
    cleaned |= {
        name: F.coalesce(F.col(name), F.lit(default)) if types[name] == "int" else lenient_int(F.col(name), default)
        for name, default in C.INTEGER_DEFAULTS.items()
        if name in types
    }
    return frame.withColumns(cleaned)


def find_column(frame: DataFrame, *fragments: str) -> str | None:
    """The first column whose name holds all fragments, in any case."""
    return next((c for c in frame.columns if all(f in c.lower() for f in fragments)), None)
