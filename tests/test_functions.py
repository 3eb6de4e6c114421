import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.functions import dates, keywords, numeric, replies, sentiment, text


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_round_half_even(spark):
    values = [0.125, 0.135, -0.125, 2.5, None]
    assert column(spark, values, "double", lambda v: numeric.round_half_even(v, 2)) == [0.12, 0.14, -0.12, 2.5, None]
    assert column(spark, [2.5, 62.5, 3.5, -2.5], "double", numeric.round_half_even) == [2, 62, 4, -2]


def test_percent_of_zero_is_null(spark):
    assert column(spark, [0, 2], "bigint", lambda v: numeric.percent(F.lit(1), v)) == [None, 50.0]


def test_band_edges(spark):
    values = [-1000.0, -999.0, -998.9, 5.0, 5.04, 15.0, 15.1, 999.0, 999.1, None]
    got = column(spark, values, "double", lambda v: numeric.band(v, *C.VARIANCE_BAND))
    assert got == ["nan", "nan", "Low", "Low", "Medium", "Medium", "High", "High", "nan", "nan"]
    assert column(spark, [None], "double", lambda v: numeric.band(v, *C.VARIANCE_BAND, outside="Unknown")) == ["Unknown"]


def test_lenient_int(spark):
    values = ["3", "2.7", "-1.9", "many", "", None, "1e2", " 3 ", "2d", "0x1p3", "NaN", "inf", "9e99"]
    got = column(spark, values, "string", lambda v: numeric.lenient_int(v, 7))
    assert got == [3, 2, -1, 7, 7, 7, 100, 3, 7, 7, 7, 7, 7]
    assert column(spark, [2.7, float("nan"), None, 1e10], "double", lambda v: numeric.lenient_int(v, 7)) == [2, 7, 7, 7]


def test_strip_matches_python(spark):
    values = ["  a b ", "\t\n x　", "\x1cy\x85", "", None, "​z"]
    assert column(spark, values, "string", text.strip) == [v if v is None else v.strip() for v in values]


def test_redaction(spark):
    cases = {
        "mail Ann.B+c@Example.org now": "mail [REDACTED_EMAIL] now",
        "call +1 (412) 555-0100 please": "call [REDACTED_PHONE] please",
        "on 2026-01-01 10 o'clock": "on [REDACTED_PHONE] o'clock",
        "customer CUST-1000, emp 1234": "customer [REDACTED_ID], [REDACTED_ID]",
        "id-99 and CUST-123456789": "id-99 and CUST-[REDACTED_PHONE]",
        "nothing here": "nothing here",
    }
    assert column(spark, list(cases), "string", text.redact) == list(cases.values())
    assert column(spark, [None], "string", text.redact) == [None]


def test_redaction_searches_past_the_cut(spark):
    value = "x" * 11_995 + " a@b.co"
    whole, = column(spark, [value], "string", lambda v: text.redact(v, None))
    cut, = column(spark, [value], "string", lambda v: text.redact(v, 12_000))
    assert whole.endswith(" [REDACTED_EMAIL]") and cut == whole[:12_000]


def test_truncate(spark):
    got = column(spark, ["abc", "abcd", None], "string", lambda v: text.truncate(v, 3))
    assert got == ["abc", "abc\n[TRUNCATED]", None]


def test_lists_as_text(spark):
    got = column(spark, [["a", "b"], []], "array<string>", text.numbered)
    assert got == ["1. a\n2. b", ""]
    assert column(spark, [["a", "b"]], "array<string>", text.bulleted) == ["- a\n- b"]


def test_whole_number(spark):
    assert column(spark, [1234.5, 1235.5, 0.0], "double", text.whole_number) == ["1,234", "1,236", "0"]


def test_lenient_dates(spark):
    values = ["2025-01-01", "2025-01-01 10:30:00", "01/02/2025", "soon", None]
    got = column(spark, values, "string", lambda v: dates.parse_time(v, lenient=True))
    assert [g is None for g in got] == [False, False, True, True, True]
    with_format, = column(
        spark, ["01/02/2025"], "string", lambda v: dates.parse_time(v, lenient=True, formats=("dd/MM/yyyy",))
    )
    assert (with_format.month, with_format.day) == (2, 1)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["soon"], "string", dates.parse_time)


SENTIMENTS = {
    "This is frustrating and I am tired of waiting": "Very Negative",
    "please CANCEL it": "Negative",
    "hello": "Neutral",
    "": "Neutral",
    None: "Neutral",
    "Thanks for the quick help": "Positive",
    "thanks, but I am unhappy and waiting": "Neutral",
    "we dwell here": "Positive",
    "cancel cancel cancel": "Negative",
}


def test_sentiment(spark):
    got = column(
        spark, list(SENTIMENTS), "string", lambda v: sentiment.label_of_score(sentiment.sentiment_score(v))
    )
    assert got == list(SENTIMENTS.values())
    assert column(spark, ["thanks"], "string", sentiment.sentiment_score) == [2]


def keywords_of(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "text string")
    return [r[0] for r in keywords.with_keyword_counts(frame, "text").select(keywords.ranked("keywords")).collect()]


def test_keyword_tokens(spark):
    value = "C++ c# Node.js, Power BI. and the of BI AB a1b2 SQL/sql x"
    assert column(spark, [value], "string", keywords.keyword_tokens) == [["c++", "node.js", "power", "bi.", "sql", "sql"]]
    assert column(spark, [None, ""], "string", keywords.keyword_tokens) == [[], []]


def test_keyword_rank_breaks_ties_by_first_occurrence(spark):
    got, nothing, missing = keywords_of(spark, ["zeta alpha beta alpha zeta gamma", "", None])
    assert [(-k["minus_n"], k["first_pos"], k["keyword"]) for k in got] == [
        (2, 0, "zeta"), (2, 1, "alpha"), (1, 2, "beta"), (1, 5, "gamma"),
    ]
    assert nothing == missing == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["red", "green", "blue", "c++", "the"]), max_size=12), min_size=1, max_size=6))
def test_keyword_counts_against_brute_force(spark, word_lists):
    got = keywords_of(spark, [" ".join(words) for words in word_lists])
    for words, found in zip(word_lists, got):
        kept = [w for w in words if w != "the"]
        want = sorted({(-kept.count(w), kept.index(w), w) for w in kept})
        assert [tuple(k) for k in found] == want


REPLIES = {
    '```json\n{"a": 1}\n```': "1",
    'Sure: {"a": {"b": 2}} bye': '{"b":2}',
    '{"a": "x"': None,
    '{"a": "x"} or {"a": "y"}': None,
    '{"a": "x"},{"a": "y"}': None,
    '{"a": }': None,
    "no object": None,
    "": None,
    None: None,
    "{}": None,
}


def test_json_replies(spark):
    got = column(spark, list(REPLIES), "string", lambda v: replies.parse_object(v, ["a"])["a"])
    assert got == list(REPLIES.values())
    empty_object, = column(spark, ["{}"], "string", lambda v: replies.parse_object(v, ["a"]).isNotNull())
    assert empty_object


def test_sanitize_list(spark):
    values = [["  a ", "", None, "x" * 200] + ["b"] * 10, None, []]
    got = column(spark, values, "array<string>", replies.sanitize_list)
    assert got == [["a", "x" * 180, "b", "b", "b", "b"], [], []]


def test_hours_are_exact(spark):
    frame = spark.sql("SELECT timestamp_ntz'2025-01-01 00:00:00' a, timestamp_ntz'2025-01-02 01:30:00' b")
    assert math.isclose(frame.select(dates.hours_between(F.col("a"), F.col("b"))).first()[0], 25.5, rel_tol=0)
