"""The batch report: a few counts and the first findings, as one JSON document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORTED_FINDINGS = 500


def batch_report(files: DataFrame, totals: DataFrame, found: DataFrame, exported_rows=None, listed_findings=REPORTED_FINDINGS) -> DataFrame:
    """One row: files, files by format, totals, findings by severity (all of them), the first findings, exported rows.

    `exported_rows` is a number or a scalar column.
    """
    by_format = files.groupBy("format").agg(F.count(F.lit(1)).alias("n"))
    formats = by_format.agg(F.array_sort(F.collect_list(F.struct("format", "n"))).alias("v")).select("v").scalar()
    levels = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    severities = levels.agg(F.array_sort(F.collect_list(F.struct("severity", "n"))).alias("v")).select("v").scalar()
    first = found.orderBy(F.desc("severity"), F.lower("file_path"), "line_no", "code").limit(listed_findings)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("severity")).alias("order"), "file_path", "line_no", "code", "severity", "message", "format", "fix_hint"
    ))).alias("v")).select("v").scalar()
    return totals.select(
        (F.col("files_processed") + F.col("files_skipped")).alias("files"), formats.alias("files_by_format"),
        "lines_valid", "ipp_unique", "collisions", severities.alias("findings_by_severity"), listed.alias("findings"),
        (exported_rows if isinstance(exported_rows, Column) else F.lit(exported_rows)).cast("bigint").alias("exported_rows"),
    )


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("value"))
