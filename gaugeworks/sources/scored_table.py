"""Scored tickets stored for lookups: partitioned by period and by a bucket of the id, sorted by id within a file."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MONTH = "yyyy-MM"


def bucket_of(ticket_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ticket_id), F.lit(buckets)).cast("int")


def store(
    scored: DataFrame, path: str, mode: str = "errorifexists", buckets: int = BUCKETS, period: str = MONTH
) -> None:
    """Write scored tickets. `period` is the date format of a partition; a period's rows are divided by `buckets`, one file each.

    Tickets without a creation time are in the period `none`. The number of buckets is part of the table: a lookup needs the same.
    """
    named = F.coalesce(F.date_format("created_at", period), F.lit("none"))
    placed = scored.withColumns({"period": F.concat(F.lit("p"), named), "bucket": bucket_of(F.col("ticket_id"), buckets)})
    placed.repartition("period", "bucket").sortWithinPartitions("period", "bucket", "ticket_id").write.mode(mode).partitionBy(
        "period", "bucket").parquet(path)


def by_period(spark: SparkSession, path: str, *periods: str) -> DataFrame:
    """The tickets of some periods, such as `2025-01`, from their files alone."""
    chosen = F.col("period").isin(*[f"p{p}" for p in periods])
    return spark.read.parquet(path).where(chosen).drop("period", "bucket")


def by_ids(spark: SparkSession, path: str, ids: DataFrame, key: str = "ticket_id", buckets: int = BUCKETS) -> DataFrame:
    """The tickets with an id of `ids`, however many and whether repeated or not, from the files of their buckets alone.

    The buckets of the ids are known before the scan is planned; there are at most `buckets` of them. Within a file, row groups
    whose range of ids holds none are left out where there are few ids.
    """
    wanted = ids.where(F.col(key).isNotNull()).select(F.col(key).alias("ticket_id")).distinct()
    touched = [r[0] for r in wanted.select(bucket_of(F.col("ticket_id"), buckets).alias("b")).distinct().collect()]
    rows = spark.read.parquet(path).where(F.col("bucket").isin(*touched) if touched else F.lit(False))
    return rows.join(wanted, "ticket_id", "left_semi").drop("period", "bucket")
