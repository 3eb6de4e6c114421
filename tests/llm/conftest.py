import random

import pytest
from llm_samples import CLASHES, COLUMNS, sentence


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, short and very long texts, copies, near copies, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    shared, base = sentence(rng, 30), sentence(rng, 200)
    texts = [
        None, "", " \t\n", "a", "one two three", base, base, base + " tail", base.replace("a", "A"), shared + " " + sentence(rng),
        sentence(rng) + "\n" + shared, shared + shared, "x" * 3000, "ab" * 2000, sentence(rng, 20_000), "ß é ́ 字 <|endoftext|> don't'll",
        "a\x1cb\x0bc", "mail a@b.co or +1 (234) 555-6789, card 4111 1111 1111 1111, ip 10.0.0.256 1.2.3.4", "١٢٣ !!!", "\U0001f600" * 70,
    ]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], i) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[5], (None, "no id at all here", None, None, None), (None, base, "en", "s9", None), (12, "same id, other text", "en", "s1", 1)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, COLUMNS).repartition(3)
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
