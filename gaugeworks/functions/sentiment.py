"""Word-list sentiment. Words are found anywhere, also inside other words; each counts once."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks import constants as C


def sentiment_score(message: Column) -> Column:
    """Positive words found minus negative words found; 0 for null."""
    text = F.lower(F.coalesce(message.cast("string"), F.lit("")))
    found = [text.contains(word).cast("int") for word in C.POSITIVE_WORDS]
    found += [-text.contains(word).cast("int") for word in C.NEGATIVE_WORDS]
    return reduce(add, found)


def label_of_score(score: Column) -> Column:
    return (
        F.when(score <= -2, "Very Negative")
        .when(score == -1, "Negative")
        .when(score == 0, "Neutral")
        .otherwise("Positive")
    )


def is_negative(label: Column) -> Column:
    return F.coalesce(label.isin(*C.NEGATIVE_LABELS), F.lit(False))
