"""Model replies as a table: prompts go out, replies come back keyed, results are merged or fall back to the rules."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.functions.replies import as_list, no_items, object_keys, parse_object, sanitize_list
from gaugeworks.functions.text import strip
from gaugeworks.operators import triage as triage_rules

LISTS = ("risk_factors", "agent_trace")
MERGED = tuple(f for f in triage_rules.FIELDS if f != "ticket_id")
FEEDBACK_FIELDS = (
    "overall_feedback", "strengths", "gaps", "resume_improvements", "interview_questions", "agent_trace",
)


def complete(prompts: DataFrame, key: str, answer: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(key, reply): the caller's function over Arrow batches of prompts. The one place that needs Python per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "reply": answer(batch["prompt"].tolist())})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {kind}, reply string")


def one_reply_per(replies: DataFrame, *keys: str, order_by: str | None = None) -> DataFrame:
    """(keys, reply, dropped_replies): at most one reply per key, so that a join cannot multiply rows.

    Of several replies the one with the largest `order_by` counts, such as the newest; without that column the last by
    text. `dropped_replies` says how many others there were.
    """
    reply = F.max("reply") if order_by is None else F.max_by("reply", F.struct(order_by, "reply"))
    return replies.dropna(subset=list(keys)).groupBy(*keys).agg(
        reply.alias("reply"), (F.count(F.lit(1)) - 1).alias("dropped_replies"))


def with_triage_reply(frame: DataFrame, reply: str = "reply", out: str = "parsed") -> DataFrame:
    """Add `out`: struct of the 14 reply fields; null for a reply that is no JSON object or whose score is no number.

    The parse is a projection of its own: inlined into each field it would run once per field.
    """
    raw, score, lists = F.col("_raw"), F.col("_score"), {name: f"_{name}" for name in LISTS}
    frame = frame.withColumn("_raw", parse_object(F.col(reply), MERGED)).withColumns(
        {"_score": raw["risk_score"].try_cast("double").try_cast("int")}
        | {column: as_list(raw[name]) for name, column in lists.items()}
    )
    fields = {name: F.col(lists[name]) if name in lists else raw[name] for name in MERGED} | {"risk_score": score}
    readable = raw.isNotNull() & (raw["risk_score"].isNull() | score.isNotNull())
    parsed = F.when(readable, F.struct(*[c.alias(name) for name, c in fields.items()]))
    return frame.withColumn(out, parsed).drop("_raw", "_score", *lists.values())


def parsed_replies(replies: DataFrame, key: str = "ticket_id") -> DataFrame:
    return with_triage_reply(replies).select(key, F.col("parsed").isNotNull().alias("is_valid"), "parsed.*")


def merge_triage(scored: DataFrame, replies: DataFrame, order_by: str | None = None) -> DataFrame:
    """Triage of every ticket, with the fields its reply gives taken over; `mode` is `model` or `rules`."""
    # Replies are joined to the narrow scored row; the wide texts are made after the shuffle. The id is unique.
    joined = scored.join(one_reply_per(replies, "ticket_id", order_by=order_by), "ticket_id", "left")
    merged = with_triage_reply(triage_rules.with_triage(joined), out="_parsed")
    valid = F.col("_parsed").isNotNull()
    asked = F.coalesce(F.col("reply"), F.lit("")) != ""
    fields = {name: F.coalesce(F.col("_parsed")[name], F.col("triage")[name]) for name in MERGED}
    outcome = F.when(valid, W.TRACE_REPLY).when(asked, W.TRACE_BAD_REPLY)
    fields["agent_trace"] = F.array_compact(F.array_append(fields["agent_trace"], outcome))
    return merged.select(
        "ticket_id",
        *[fields[name].alias(name) for name in MERGED],
        F.when(valid, "model").otherwise("rules").alias("mode"),
    )


def with_feedback_reply(
    frame: DataFrame, fallback: dict[str, Column], reply: str = "reply", out: str = "parsed",
    max_chars: int = C.MAX_REPLY_CHARS, max_items: int = C.MAX_REPLY_ITEMS, max_item_chars: int = C.MAX_REPLY_ITEM_CHARS,
) -> DataFrame:
    """Add `out`: struct of the six feedback fields with per-field fallback; null if there is no object.

    The overall text is cut to `max_chars`, lists to `max_items` of `max_item_chars` each.
    """
    raw, keys = F.col("_raw"), F.col("_keys")
    frame = frame.withColumns({"_raw": parse_object(F.col(reply), FEEDBACK_FIELDS), "_keys": object_keys(F.col(reply))})
    fields = {}
    for name in FEEDBACK_FIELDS:
        if name == "overall_feedback":
            given = F.nullif(raw[name], F.lit(""))
            fields[name] = F.substring(strip(F.coalesce(given, fallback[name])), 1, max_chars)
        else:
            # A key that is there but holds no list counts as an empty list.
            items = F.when(F.array_contains(keys, name), F.coalesce(as_list(raw[name]), no_items()))
            fields[name] = sanitize_list(F.coalesce(items, fallback[name]), max_items, max_item_chars)
    trace = fields["agent_trace"]
    fields["agent_trace"] = F.when(F.size(trace) > 0, trace).otherwise(fallback["agent_trace"])
    parsed = F.when(raw.isNotNull(), F.struct(*[c.alias(name) for name, c in fields.items()]))
    return frame.withColumn(out, parsed).drop("_raw", "_keys")
