"""Keywords of a text, computed inside its row: no explode, no shuffle, no Python."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as C


def keyword_tokens(text: Column) -> Column:
    """Lower-cased keyword tokens in order of appearance, repeats included; empty for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(C.KEYWORD_PATTERN), F.lit(0))
    return F.filter(
        words, lambda word: (F.length(word) >= C.MIN_KEYWORD_CHARS) & ~word.isin(*C.STOP_WORDS)
    )


def with_keyword_counts(frame: DataFrame, text: str, out: str = "keywords") -> DataFrame:
    """Add `out`: array of (minus_n, first_pos, keyword), one entry per distinct keyword, unranked.

    Sorting the (word, position) pairs puts equal words side by side, so a count is the distance between the starts
    of two neighbouring runs: n log n per text, where counting each distinct word would be quadratic.
    """
    pairs, starts = f"_{out}_pairs", f"_{out}_starts"
    frame = frame.withColumn(
        pairs,
        F.sort_array(
            F.transform(keyword_tokens(F.col(text)), lambda word, i: F.struct(word.alias("word"), i.alias("pos")))
        ),
    )
    frame = frame.withColumn(
        starts,
        F.when(
            F.size(pairs) > 0,
            F.filter(
                F.sequence(F.lit(0), F.size(pairs) - 1),
                lambda i: (i == 0) | (F.col(pairs)[i]["word"] != F.col(pairs)[F.greatest(i - 1, F.lit(0))]["word"]),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    counted = F.transform(
        F.col(starts),
        lambda start, j: F.struct(
            (start - F.coalesce(F.get(F.col(starts), j + 1), F.size(pairs))).alias("minus_n"),
            F.col(pairs)[start]["pos"].alias("first_pos"),
            F.col(pairs)[start]["word"].alias("keyword"),
        ),
    )
    return frame.withColumn(out, counted).drop(pairs, starts)


def ranked(keywords: str) -> Column:
    """A `with_keyword_counts` array, most frequent first, ties by first occurrence."""
    return F.sort_array(keywords)


# A run of characters that may belong to one keyword, from the start of a text.
_RUN = r"^[a-z+#.]*"
_RUN_CHARS = 10_000


def text_pieces(rows: DataFrame, text: str, size: int) -> DataFrame:
    """The rows with `text` cut into pieces of about `size` characters, one row each, numbered by `piece`.

    A piece starts behind the run of keyword characters that stands at its place, so no keyword is cut: the tokens of the
    pieces, in order, are those of the whole text. A piece that one run covers is empty.
    """
    whole = rows.withColumn(text, F.lower(F.col(text)))
    starts = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))))

    def start(piece: Column) -> Column:
        at = piece * size + 1
        run = F.length(F.regexp_extract(F.substring(F.col(text), at, F.lit(_RUN_CHARS)), _RUN, 0))
        longer = F.length(F.regexp_extract(F.substring(F.col(text), at, F.length(text)), _RUN, 0))
        return F.when(piece <= 0, F.lit(1)).otherwise(at + F.when(run < _RUN_CHARS, run).otherwise(longer))

    cut = starts.withColumns({"_from": start(F.col("piece")), "_to": start(F.col("piece") + 1)})
    return cut.withColumn(text, F.substring(F.col(text), F.col("_from"), F.col("_to") - F.col("_from"))).drop("_from", "_to")
