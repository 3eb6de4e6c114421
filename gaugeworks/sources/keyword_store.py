"""Keyword tables kept for many rounds of matching: bucketed and sorted by id, so that new pairs come to them.

A bucketed table is known to the catalog. Its files lie below a path of the caller's, and a later session with a catalog of its
own declares it again by `open_table`.
"""

from pyspark.sql import DataFrame, SparkSession


def store(keywords: DataFrame, table: str, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write a frame with one row per `key` as a bucketed table and return it as such.

    A join leaves the table in place if it has at least as many buckets as the session has shuffle partitions, which is the
    default. Each bucket is one file.
    """
    spark = keywords.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keywords.repartition(count, key)
    placed.write.bucketBy(count, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def open_table(spark: SparkSession, table: str, path: str, key: str, columns: str, buckets: int) -> DataFrame:
    """The table below `path`, declared again: `columns` is its DDL and `buckets` the number that it was stored with."""
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(table)
