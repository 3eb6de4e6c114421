"""Text columns: strip, redact, cut, fill templates, join."""

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks import constants as C


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends (`trim` alone removes blanks only)."""
    return F.trim(text, F.lit(C.WHITESPACE))


def redact(text: Column, max_chars: int | None = None) -> Column:
    """Mask e-mail addresses, then phone-like runs, then prefixed ids; cut to `max_chars` if that is given.

    The whole text is searched before the cut. `(?U)` gives \\b, \\d and \\s their Unicode meaning. Texts without an @ skip
    the first pattern and texts without a digit the other two, as these cannot match there.
    """

    def mask(value: Column, pattern: str, mark: str, flags: str = "(?iU)") -> Column:
        return F.regexp_replace(value, flags + pattern, mark)

    mailed = F.when(text.contains("@"), mask(text, C.EMAIL_PATTERN, C.EMAIL_MARK)).otherwise(text)
    called = mask(mailed, C.PHONE_PATTERN, C.PHONE_MARK, "(?U)")
    masked = F.when(text.rlike(r"\p{Nd}"), mask(called, C.ID_PATTERN, C.ID_MARK)).otherwise(mailed)
    return masked if max_chars is None else F.substring(masked, 1, max_chars)


def truncate(text: Column, max_chars: int | None) -> Column:
    """Cut to `max_chars` and say so on a line of its own; whole if that is None."""
    if max_chars is None:
        return text
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(C.TRUNCATION_MARK))
    ).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def fill(template: str, **slots: Column) -> Column:
    """A template with its `{slots}` replaced by columns; null if a slot is null."""
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot:
            parts.append(slots[slot].cast("string"))
    return F.concat(*parts)


def whole_number(value: Column) -> Column:
    """Thousands separators, no decimals, halves to even: 1,234,567."""
    return F.format_number(value, 0)


def lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def join(items: Column, separator: str = ", ") -> Column:
    return F.array_join(items, separator)


def numbered(items: Column) -> Column:
    """An array of strings as `1. first`, `2. second`, ... on lines."""
    return F.array_join(
        F.transform(items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item)), "\n"
    )


def bulleted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("- "), item)), "\n")


def present(*conditions_and_texts) -> Column:
    """An array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(when, text) for when, text in conditions_and_texts]))
