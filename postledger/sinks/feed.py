"""Feed messages and registry output."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_messages(rows: DataFrame, path: str) -> None:
    """Text of each message under ``part=N``; its files in name order are the
    message. Rows are range-partitioned, so a long message spans several files."""
    order = ["part", "section", "pos", "key"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.select("part", "text").write.mode("overwrite").partitionBy("part").text(path)


def write_registry(outcomes: DataFrame, path: str) -> None:
    """Registry annotated with the discovery outcome."""
    outcomes.write.mode("overwrite").json(path)
