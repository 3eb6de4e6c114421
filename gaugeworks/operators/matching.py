"""Resumes against job descriptions.

Keywords are found inside each text's row; pairs come from the caller (who applies for what), so work grows with the
pairs, not with resumes times jobs. A pair row meets its two keyword arrays in two lookup joins by id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks import wording as W
from gaugeworks.functions.keywords import keyword_tokens, ranked, text_pieces, with_keyword_counts
from gaugeworks.functions.numeric import round_half_even
from gaugeworks.functions.text import bulleted, fill, join, lines, numbered, redact, strip, truncate
from gaugeworks.operators.replies import FEEDBACK_FIELDS, one_reply_per, with_feedback_reply
from gaugeworks.operators.skew import ROWS_PER_PART, attach, hot_keys

LONG_TEXT_CHARS = 1_000_000


def non_blank(frame: DataFrame, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Rows with a text. `max_chars` cuts texts as an input form would; by default they stay whole."""
    kept = frame.where(F.length(strip(F.col(text))) > 0)
    return kept if max_chars is None else kept.withColumn(text, truncate(F.col(text), max_chars))


def keyword_counts(frame: DataFrame, key: str, text: str = "text", long_chars: int | None = None) -> DataFrame:
    """(key, keyword, n, first_pos): every distinct keyword of every text.

    Texts are counted within their row, without a shuffle. With `long_chars` (such as LONG_TEXT_CHARS), longer ones are cut into
    pieces of about that size, which go to tasks of their own; each piece's counts and first positions are then merged by
    keyword. That reads the texts a second time.
    """
    rows = frame.select(key, F.col(text).alias("text"))
    if long_chars is None:
        return _counted_rows(rows, [key])
    short = rows.where(F.coalesce(F.length("text") <= long_chars, F.lit(True)))
    return _counted_rows(short, [key]).select(key, "keyword", "n", "first_pos").unionAll(
        _long_keyword_counts(rows.where(F.length("text") > long_chars), key, long_chars))


def _counted_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    counted = with_keyword_counts(rows.select(*keys, "text"), "text")
    # The outer form: for the inner one the optimizer would copy the whole computation into a size > 0 filter.
    listed = counted.select(*keys, F.inline_outer("keywords")).where(F.col("keyword").isNotNull())
    return listed.select(*keys, "keyword", (-F.col("minus_n")).alias("n"), "first_pos")


def _long_keyword_counts(rows: DataFrame, key: str, piece_chars: int) -> DataFrame:
    """`keyword_counts` of long texts. A text is a row of its own: rows that share a key are not merged."""
    pieces = text_pieces(rows.withColumn("_row", F.monotonically_increasing_id()), "text", piece_chars)
    # With both columns, so that the pieces of one text spread; written partitions do not depend on the row number's order.
    counted = _counted_rows(pieces.repartition("_row", "piece"), [key, "_row", "piece"])
    within = Window.partitionBy("_row").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("_row", "piece").agg(F.sum("n").alias("tokens"))
    before = sizes.select("_row", "piece", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("before"))
    merged = counted.groupBy(key, "_row", "keyword").agg(
        F.sum("n").cast("int").alias("n"), F.min(F.struct("piece", "first_pos")).alias("first"))
    placed = merged.withColumn("piece", F.col("first.piece")).join(before, ["_row", "piece"])
    return placed.select(key, "keyword", "n", (F.col("before") + F.col("first.first_pos")).cast("int").alias("first_pos"))


def ranked_keywords(frame: DataFrame, key: str, text: str = "text", n: int = C.TOP_KEYWORDS) -> DataFrame:
    """(key, rank, keyword, n): the n most frequent keywords per text, ties by first occurrence. No shuffle."""
    counted = with_keyword_counts(frame.select(key, text), text)
    listed = counted.select(key, F.posexplode_outer(F.slice(ranked("keywords"), 1, n)).alias("pos", "k"))
    return listed.where(F.col("pos").isNotNull()).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("k.keyword"), (-F.col("k.minus_n")).alias("n")
    )


def match_pairs(
    pairs: DataFrame, resumes: DataFrame, jds: DataFrame, n: int = C.TOP_KEYWORDS, replies: DataFrame | None = None,
    with_texts: bool = False, max_chars: int | None = None, rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """(resume_id, jd_id, score, matched, missing) for each pair whose two texts exist.

    Each pair is taken once. `matched` and `missing` keep the rank order of the job's keywords; score is the matched share
    in percent. `replies` (resume_id, jd_id, reply) adds the pair's reply, joined before the keyword arrays; `with_texts`
    adds both redacted texts as `resume` and `jd`, which come along with the keywords, cut to `max_chars` if that is given.
    """
    ids = ["resume_id", "jd_id"]

    def texts(name: str) -> list[Column]:
        return [redact(truncate(F.col("text"), max_chars), max_chars).alias(name)] if with_texts else []

    wanted = with_keyword_counts(jds.select("jd_id", "text", *texts("jd")), "text").select(
        "jd_id", F.slice(F.transform(ranked("keywords"), lambda k: k["keyword"]), 1, n).alias("wanted"), *(["jd"] * with_texts)
    )
    offered = resumes.select("resume_id", F.array_distinct(keyword_tokens(F.col("text"))).alias("offered"), *texts("resume"))
    # The job side adds a few words per pair, the resume side a whole vocabulary: it is joined last.
    each = pairs.select(*ids).distinct()
    narrow = each if replies is None else each.join(one_reply_per(replies, *ids), ids, "left").drop("dropped_replies")
    joined = attach(narrow, wanted, "jd_id", ["resume_id"], hot_keys(pairs, "jd_id", rows_per_part), "inner")
    joined = attach(joined, offered, "resume_id", ["jd_id"], hot_keys(pairs, "resume_id", rows_per_part), "inner")
    more = [*(["reply"] if replies is not None else []), *(["resume", "jd"] * with_texts)]
    return _compared(joined, *more)


def _compared(joined: DataFrame, *more: str) -> DataFrame:
    ids = ["resume_id", "jd_id"]
    compared = joined.select(*ids, "wanted", F.array_intersect("wanted", "offered").alias("matched"), *more)
    share = F.size("matched").cast("double") / F.greatest(F.size("wanted"), F.lit(1))
    return compared.select(
        "resume_id",
        "jd_id",
        round_half_even(share * 100.0).cast("int").alias("score"),
        "matched",
        F.array_except("wanted", "matched").alias("missing"),
        *more,
    )


def job_keywords(jds: DataFrame, n: int = C.TOP_KEYWORDS) -> DataFrame:
    """(jd_id, wanted): a job's n keywords in rank order, for a table that is kept (`sources.keyword_store`)."""
    counted = with_keyword_counts(jds.select("jd_id", "text"), "text")
    return counted.select("jd_id", F.slice(F.transform(ranked("keywords"), lambda k: k["keyword"]), 1, n).alias("wanted"))


def resume_keywords(resumes: DataFrame) -> DataFrame:
    """(resume_id, offered): the distinct keywords of a resume, for a table that is kept."""
    return resumes.select("resume_id", F.array_distinct(keyword_tokens(F.col("text"))).alias("offered"))


def match_stored(pairs: DataFrame, wanted: DataFrame, offered: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """As `match_pairs`, with keyword tables stored by id: pairs are sent to them, and they stay where they are.

    Ids with more than `rows_per_part` pairs are taken apart: of the tables, only their rows are sent, to salted parts.
    """
    met = _at_home(pairs.select("resume_id", "jd_id").distinct(), wanted, "jd_id", "resume_id", rows_per_part)
    return _compared(_at_home(met, offered, "resume_id", "jd_id", rows_per_part))


def _at_home(pairs: DataFrame, stored: DataFrame, key: str, other: str, rows_per_part: int) -> DataFrame:
    hot = hot_keys(pairs, key, rows_per_part)
    hot_rows = stored.join(hot.select(key), key, "left_semi")
    usual = pairs.join(hot.select(key), key, "left_anti").join(stored, key)
    heavy = attach(pairs.join(hot.select(key), key, "left_semi"), hot_rows, key, [other], hot, "inner")
    return usual.unionByName(heavy)


def keyword_coverage(matches: DataFrame) -> DataFrame:
    """(resume_id, jd_id, category, count): matched and missing keywords of each pair."""
    both = F.array(
        F.struct(F.lit("Matched").alias("category"), F.size("matched").cast("bigint").alias("count")),
        F.struct(F.lit("Missing").alias("category"), F.size("missing").cast("bigint").alias("count")),
    )
    return matches.select("resume_id", "jd_id", F.inline_outer(both))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _advice(keywords: str, line: str, nothing: str) -> Column:
    """A line for each of the first keywords of a list; one line of its own if the list is empty."""
    made = F.transform(F.slice(keywords, 1, W.ADVICE_ITEMS), lambda k: fill(line, keyword=k))
    return F.when(F.size(keywords) > 0, made).otherwise(_texts([nothing]))


def _fallback_fields(max_items: int) -> dict[str, Column]:
    return {
        "overall_feedback": fill(W.FEEDBACK, score=F.col("score")),
        "strengths": F.slice("matched", 1, max_items),
        "gaps": F.slice("missing", 1, max_items),
        "resume_improvements": _advice("missing", W.IMPROVEMENT, W.NOTHING_MISSING),
        "interview_questions": _advice("matched", W.QUESTION, W.NOTHING_MATCHED),
        "agent_trace": _texts([W.FEEDBACK_TRACE]),
    }


def candidate_feedback(
    matches: DataFrame, max_chars: int = C.MAX_REPLY_CHARS, max_items: int = C.MAX_REPLY_ITEMS,
    max_item_chars: int = C.MAX_REPLY_ITEM_CHARS,
) -> DataFrame:
    """The six feedback fields per pair, from its reply where `match_pairs` was given replies and it can be read.

    Replies are cut: the overall text to `max_chars`, lists to `max_items` of `max_item_chars` each.
    """
    fallback = _fallback_fields(max_items)
    ids = ["resume_id", "jd_id"]
    if "reply" not in matches.columns:
        return matches.select(*ids, "score", *[c.alias(name) for name, c in fallback.items()])
    joined = with_feedback_reply(
        matches, fallback, out="_given", max_chars=max_chars, max_items=max_items, max_item_chars=max_item_chars)
    valid = F.col("_given").isNotNull()
    asked = F.coalesce(F.col("reply"), F.lit("")) != ""
    fields = {name: F.when(valid, F.col("_given")[name]).otherwise(fallback[name]) for name in FEEDBACK_FIELDS}
    outcome = F.when(valid, W.FEEDBACK_REPLY_TRACE).when(asked, W.FEEDBACK_BAD_REPLY)
    fields["agent_trace"] = F.array_compact(F.array_append(fields["agent_trace"], outcome))
    return joined.select(*ids, "score", *[c.alias(name) for name, c in fields.items()])


def candidate_prompts(matches: DataFrame) -> DataFrame:
    """(resume_id, jd_id, prompt) from a match with texts."""
    prompt = fill(
        W.CANDIDATE_PROMPT,
        keys=F.lit(", ".join(FEEDBACK_FIELDS)),
        score=F.col("score"),
        matched=join(F.col("matched")),
        missing=join(F.col("missing")),
        resume=F.col("resume"),
        jd=F.col("jd"),
    )
    return matches.select("resume_id", "jd_id", prompt.alias("prompt"))


def _section(title: str, body: Column) -> list[Column]:
    return [F.lit(""), F.lit(f"{title}:"), body]


def candidate_report(matches: DataFrame, shown: int = 20) -> DataFrame:
    """(resume_id, jd_id, report) from the keyword match alone."""
    report = lines(
        F.lit(W.CANDIDATE_HEADING),
        F.lit(""),
        fill(W.CANDIDATE_SCORE, score=F.col("score")),
        *_section("Matched keywords", join(F.slice("matched", 1, shown))),
        *_section("Missing keywords", join(F.slice("missing", 1, shown))),
        *_section("Improvements", numbered(_advice("missing", W.IMPROVEMENT, W.NOTHING_MISSING))),
        *_section("Interview questions", numbered(_advice("matched", W.QUESTION, W.NOTHING_MATCHED))),
    )
    return matches.select("resume_id", "jd_id", report.alias("report"))


def feedback_report(feedback: DataFrame) -> DataFrame:
    """(resume_id, jd_id, report) from a `candidate_feedback` frame."""
    report = lines(
        F.lit(W.CANDIDATE_HEADING),
        F.lit(""),
        fill(W.CANDIDATE_SCORE, score=F.col("score")),
        *_section("Feedback", F.col("overall_feedback")),
        *_section("Strengths", bulleted(F.col("strengths"))),
        *_section("Gaps", bulleted(F.col("gaps"))),
        *_section("Improvements", numbered(F.col("resume_improvements"))),
        *_section("Interview questions", numbered(F.col("interview_questions"))),
        *_section("Steps", bulleted(F.col("agent_trace"))),
    )
    return feedback.select("resume_id", "jd_id", report.alias("report"))
