"""Report and CSV writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragassay.operators.export import with_header


def write_reports(reports: DataFrame, folder: str) -> None:
    """One indented JSON document per job under its report file name.

    Reports of the given jobs are replaced, those of other jobs stay.
    """
    text = F.to_json("report", {"pretty": "true"}).alias("value")
    (
        reports.select("report_file", "job_id", text)
        .repartition("report_file", "job_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_file", "job_id")
        .text(folder)
    )


def write_evaluation_csv(rows: DataFrame, folder: str) -> None:
    """CSV with titled columns; quotes inside values are doubled, blanks stay."""
    (
        with_header(rows)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
