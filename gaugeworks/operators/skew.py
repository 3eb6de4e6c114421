"""A lookup join that stays even when one key holds a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_PART = 1_000_000


def hot_keys(frame: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(key, salts): keys with more than `rows_per_part` rows, and how many parts of at most that size they need.

    An exact count, combined in the tasks before its shuffle. Call it on a base table and share the result.
    """
    counted = frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return salts(counted, key, "_rows", rows_per_part)


def salts(counted: DataFrame, key: str, rows: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The same from a frame that has the rows of each key already."""
    parts = F.ceil(F.col(rows) / rows_per_part).cast("int")
    return counted.where(F.col(rows) > rows_per_part).select(key, parts.alias("_salts"))


def attach(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Join `right`, which holds one row per key, onto `left`.

    Rows of the keys in `hot` are spread over salts by the hash of `spread_by`, and the key's single right row is copied to
    each. Null keys match nothing and are spread over all salts there are. How the sides meet is left to adaptive execution,
    which knows their sizes.
    """
    spread = F.xxhash64(*spread_by)
    salt = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(1 << 30))).otherwise(F.pmod(spread, F.coalesce("_salts", F.lit(1))))
    salted_left = left.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
