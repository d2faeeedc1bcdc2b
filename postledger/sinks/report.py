"""Report files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import report


def write_json_report(postings: DataFrame, header: DataFrame, errors: DataFrame, path: str) -> None:
    """JSON lines: postings by status, one run header and the source errors."""
    report.json_rows(postings).write.mode("overwrite").partitionBy("status").json(f"{path}/jobs")
    header.write.mode("overwrite").json(f"{path}/run")
    errors.select(F.format_string("%s (%s)", "company_id", "source_type").alias("source"), "error").write.mode(
        "overwrite").json(f"{path}/source_errors")


def write_markdown_report(rows: DataFrame, path: str) -> None:
    """Text files whose names sort into the report's order."""
    rows.orderBy("section_ord", "row_ord", "sort_key").select("line").write.mode("overwrite").text(path)


def archive_report(rows: DataFrame, path: str, day: Column) -> None:
    """Dated copy of the report rows; the day's folder is replaced."""
    dated = rows.withColumn("dt", F.date_format(day, "yyyy-MM-dd"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
