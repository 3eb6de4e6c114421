"""Writing results."""

from pyspark.sql import DataFrame

from gaugeworks.sources.tables import CSV_OPTIONS


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file per partition; nulls are empty, and empty text is quoted."""
    frame.write.mode(mode).options(**CSV_OPTIONS, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A frame with one `report` column as plain text."""
    report.select("report").write.mode(mode).text(path)


def write_table(frame: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    frame.write.mode(mode).partitionBy(*partition_by).parquet(path)
