"""JSON replies of a model, as string columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.functions.text import strip


def json_object(reply: Column) -> Column:
    """From the first `{` to the last `}` (so code fences and chatter fall away); null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def parse_object(reply: Column, keys) -> Column:
    """Struct of the given keys as raw strings (lists and objects stay JSON text); null unless the whole is one object.

    Parsed as the only element of an array, so trailing or missing text makes the parse fail as a whole.
    """
    schema = "array<struct<" + ",".join(f"`{key}`:string" for key in keys) + ">>"
    parsed = F.from_json(F.concat(F.lit("["), json_object(reply), F.lit("]")), schema)
    return F.when(F.size(parsed) == 1, parsed[0])


def object_keys(reply: Column) -> Column:
    return F.json_object_keys(json_object(reply))


def as_list(raw: Column) -> Column:
    """JSON list text to array of strings; null for anything else."""
    return F.from_json(raw, "array<string>")


def no_items() -> Column:
    return F.array().cast("array<string>")


def sanitize_list(items: Column, max_items: int = C.MAX_REPLY_ITEMS, max_chars: int = C.MAX_REPLY_ITEM_CHARS) -> Column:
    """First `max_items`, each stripped then cut, blanks and nulls dropped last; empty for null."""
    cut = F.transform(F.slice(items, 1, max_items), lambda item: F.substring(strip(item), 1, max_chars))
    kept = F.filter(cut, lambda item: F.coalesce(item != "", F.lit(False)))
    return F.coalesce(kept, no_items())
