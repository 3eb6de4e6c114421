"""Helpers of the operators: reading, Arrow batches, tables in the shared folder."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gaugeworks.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 500
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, whatever other columns are there; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(frame: DataFrame, function, schema: str) -> DataFrame:
    """`function` gets the columns of some rows as lists and returns the columns of the schema as lists or arrays.

    It sees SLICE_ROWS rows at a time, so Python never holds a whole batch of long texts as objects.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = function(*(c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns))
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return frame.mapInArrow(run, schema)


class SharedTables:
    """Tables of one run in a folder of their own below spark.checkpoint.dir, as lineage ends there.

    `write` returns the frame read back. `drop` deletes a table that a later one has replaced. What a returned frame still
    reads stays until the owner of the run drops it, or the shared folder's own clean-up does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, frame: DataFrame, table: str, *by: str) -> DataFrame:
        """With columns `by`, each of their values is a folder that may be dropped by itself."""
        frame.write.mode("overwrite").partitionBy(*by).parquet(self.path(table))
        return self.spark.read.schema(frame.schema).parquet(self.path(table))

    def drop(self, table: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table).rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
