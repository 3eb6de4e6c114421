"""Reading tickets, costs and texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks import constants as C
from gaugeworks import schemas
from gaugeworks.functions.dates import parse_date, parse_time
from gaugeworks.functions.numeric import decimal_number
from gaugeworks.functions.text import is_blank
from gaugeworks.operators.cleaning import strip_column_names

# A doubled quote inside quotes is a quote, as other CSV writers have it.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


class UploadRejected(ValueError):
    """A file breaks a limit of `read_guarded_csv`."""


def tokens_to_null(frame: DataFrame) -> DataFrame:
    """Turn the missing-value tokens of text columns into null."""
    text = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    return frame.withColumns({c: F.when(~F.col(c).isin(*C.MISSING_TOKENS), F.col(c)) for c in text})


def read_csv(
    spark: SparkSession, path: str, multiline: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """All columns as text, missing tokens as null.

    With `columns`, the names in the files' order, nothing is read to plan, and a file whose header differs raises when it
    is read. Without, the first file names the columns, so all files must order theirs alike. `multiline` allows line
    breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multiline, inferSchema=False)
    if columns is not None:
        declared = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(declared).option("enforceSchema", False)
    frame = reader.csv(path)
    return tokens_to_null(strip_column_names(frame))


def read_guarded_csv(
    spark: SparkSession,
    path: str,
    max_rows: int = C.MAX_UPLOAD_ROWS,
    max_bytes: int = C.MAX_UPLOAD_BYTES,
    max_columns: int = C.MAX_UPLOAD_COLUMNS,
    multiline: bool = False,
) -> DataFrame:
    """`read_csv` with the limits of an upload form; raises UploadRejected instead of reading a part."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is None or size > max_bytes:
        raise UploadRejected(f"the file holds {size or 0} bytes, allowed are 1 to {max_bytes}")
    try:
        frame = read_csv(spark, path, multiline)
    except Exception as error:
        raise UploadRejected("the file cannot be read as CSV") from error
    if len(frame.columns) > max_columns:
        raise UploadRejected(f"the file has {len(frame.columns)} columns, allowed are {max_columns}")
    if frame.limit(max_rows + 1).count() > max_rows:
        raise UploadRejected(f"the file has more than {max_rows} rows")
    return frame


def cast_to(
    frame: DataFrame, schema: T.StructType, lenient: bool = True, formats: tuple[str, ...] = ()
) -> DataFrame:
    """Cast the columns a schema knows; the others stay as they are. Bad values are null, or raise if not lenient.

    Dates and times are ISO text or of one of the `formats`.
    """
    types = {f.name: f.dataType for f in schema}

    def one(name: str):
        kind = types[name]
        if isinstance(kind, T.TimestampNTZType):
            return parse_time(F.col(name), lenient, formats)
        if isinstance(kind, T.DateType) and formats:
            read = parse_date(F.col(name), formats)
            return read if lenient else F.coalesce(read, F.col(name).cast(kind))
        if isinstance(kind, T.IntegerType):
            return decimal_number(F.col(name)).try_cast("int") if lenient else F.col(name).cast("double").cast("int")
        return F.col(name).try_cast(kind) if lenient else F.col(name).cast(kind)

    return frame.withColumns({c: one(c) for c in frame.columns if c in types})


def rejected_cells(frame: DataFrame, schema: T.StructType, formats: tuple[str, ...] = ()) -> DataFrame:
    """One row: for each column the schema knows, how many cells a lenient cast makes null or rounds."""
    known = [f for f in schema if f.name in frame.columns]
    cast = cast_to(frame.select(*[F.col(f.name).alias(f"raw_{f.name}") for f in known], *[f.name for f in known]), schema, True, formats)

    def lost(field: T.StructField):
        raw, value = F.col(f"raw_{field.name}"), F.col(field.name)
        bad = raw.isNotNull() & value.isNull()
        if isinstance(field.dataType, T.DecimalType):
            bad = bad | (raw.try_cast("decimal(38,18)") != value.cast("decimal(38,18)"))
        return F.count_if(F.coalesce(bad, F.lit(False))).alias(field.name)

    return cast.agg(*[lost(f) for f in known])


def load(
    spark: SparkSession, source: str, format: str | None = None, multiline: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """A table by name, qualified or not, or a path: CSV (`.csv` or `format="csv"`), else parquet or the given format."""
    if format is None and "/" not in source and ("." not in source or spark.catalog.tableExists(source)):
        return spark.read.table(source)
    if format == "csv" or (format is None and source.rstrip("/").endswith(".csv")):
        return read_csv(spark, source, multiline, columns)
    return spark.read.format(format or "parquet").load(source)


def load_tickets(spark: SparkSession, source: str, label: str | None = None, **options) -> DataFrame:
    """Tickets from any source with a `source` column: the label, or the table name or path."""
    frame = strip_column_names(load(spark, source, **options))
    return frame.withColumn("source", F.lit(label or source))


def load_costs(
    spark: SparkSession, source: str, lenient: bool = True, formats: tuple[str, ...] = (), **options
) -> DataFrame:
    """Costs from any source. Unreadable cells are null and further decimals are rounded, or raise if not lenient.

    `rejected_cells` counts them beforehand.
    """
    raw = strip_column_names(load(spark, source, **options))
    if not lenient:
        money = [f.name for f in schemas.COSTS if isinstance(f.dataType, T.DecimalType) and f.name in raw.columns]
        exact = {c: F.col(c).cast("decimal(38,18)") for c in money}
        raw = raw.withColumns({
            c: F.when(v == F.round(v, 2), v).when(v.isNotNull(), F.raise_error(F.concat(F.lit(f"{c} has more than two decimals: "), F.col(c).cast("string"))))
            for c, v in exact.items()
        })
    return cast_to(raw, schemas.COSTS, lenient, formats)


def load_texts(spark: SparkSession, source: str, key: str, text: str = "text", **options) -> DataFrame:
    """(key, text), without blank texts."""
    return load(spark, source, **options).select(key, F.col(text).alias("text")).where(~is_blank(F.col("text")))


def inline_costs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A cost table from literal rows of ISO text and numbers."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.COSTS])
    return cast_to(spark.createDataFrame([tuple(str(v) for v in row) for row in rows], raw), schemas.COSTS, False)


def register_tickets(frame: DataFrame, name: str = "support_tickets") -> DataFrame:
    """The frame under the declared ticket schema, as a view for SQL."""
    have = set(frame.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TICKETS
    ]
    table = frame.select(*columns)
    table.createOrReplaceTempView(name)
    return table
