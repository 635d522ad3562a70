"""Reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
