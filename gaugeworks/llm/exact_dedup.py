"""Exact dedup by distributed MSD radix partitioning.

All documents start in one group. Each round splits every group by the next digit, a run of successive bytes, and drops
the groups that are done: those of one document, and those whose texts have ended, which are equal. No digest decides
equality. Digits widen from round to round, so a text of n bytes takes about log(n) rounds.

A round counts its digits with partial aggregation and joins the counts of the repeated ones back. A group that holds a
third of all rows is one row per task in the first shuffle, and a skewed partition that adaptive execution splits in the
second. Only documents that are still undecided go on, with the bytes not yet read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SharedTables, texts

FIRST_DIGIT = 64
WIDEN = 8


def _tail(rest: str, width: int):
    return F.expr(f"substring({rest}, {width + 1}, greatest(length({rest}) - {width}, 0))")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    keep_id is the largest doc_id of the group of equal texts. Null texts count as empty, and empty texts are equal. A null
    doc_id is smaller than any other. Rows that repeat both doc_id and text are all marked as kept; `keep` leaves one.
    An empty table gives an empty result.

    A group is named by the largest (doc_id, sha) among its members. The sha only tells apart rows of the same doc_id.
    """
    spark = docs.sparkSession
    tables = SharedTables(spark, "exact-dedup")
    state = texts(docs, id_col, text_col).select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.lit(None).cast("struct<doc_id:long,sha:string>").alias("grp"),
        F.col("text").cast("binary").alias("rest"),
    )
    width, done, turn = first_digit, [], 0
    while True:
        split = state.select(
            "doc_id", "sha", "grp", F.expr(f"substring(rest, 1, {width})").alias("digit"), _tail("rest", width).alias("rest"),
        )
        repeated = (
            split.groupBy("grp", "digit")
            .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "sha")).alias("top"))
            .where("size > 1")
            .withColumnsRenamed({"grp": "of", "digit": "by"})
        )
        joined = split.join(repeated, F.col("grp").eqNullSafe(F.col("of")) & (F.col("digit") == F.col("by")), "left")
        ended = F.col("top").isNull() | (F.length("digit") < width)
        written = tables.write(
            joined.select(
                "doc_id", "sha", ended.alias("ended"), F.coalesce("top", F.struct("doc_id", "sha")).alias("grp"),
                F.coalesce("size", F.lit(1)).alias("size"), F.when(~ended, F.col("rest")).alias("rest"),
            ),
            f"round-{turn}",
        )
        done.append(written.where("ended"))
        state = written.where("NOT ended").select("doc_id", "sha", "grp", "rest")
        if state.isEmpty():
            break
        width, turn = width * WIDEN, turn + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    keep = F.col("grp.doc_id")
    return result.select(
        "doc_id", keep.alias("keep_id"), F.col("size").cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row for each text. An empty table stays empty."""
    found = annotate(docs).where("kept").select(F.col("doc_id").alias("stays_id"), F.col("text_sha256").alias("stays_sha")).distinct()
    # The row travels as one struct, so that no column of the caller's can clash.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("stays_id")) & (F.col("sha") == F.col("stays_sha"))
    return rows.join(found, same, "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
