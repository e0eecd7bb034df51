"""Warehouse and report sinks.

Tables are written to the shared folder (the session's checkpoint folder
on a cluster), never to a machine-local path.  Writes are whole-table
overwrites, so a retried job leaves no partial duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One typed warehouse table as parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_warehouse(tables: dict[str, DataFrame], root: str,
                    partitioning: dict[str, list[str]] | None = None) -> None:
    """Every table of the warehouse under ``root/<name>``."""
    partitioning = partitioning or {}
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", partitioning.get(name))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_routed(changes: DataFrame, path: str) -> None:
    """One change table partitioned by interface; the REST, AJAX and
    WP-CLI tables are its partitions (pruned when read with a filter)."""
    write_table(changes, path, ["interface"])


def write_report_csv(report: DataFrame, path: str, one_file: bool = True) -> None:
    """A report as one CSV file, for reports with a bounded number of rows
    such as one per rule.  Others are written in parallel (``one_file=False``):
    their part files, by name, hold the order."""
    if one_file:
        report = report.coalesce(1)
    report.write.mode("overwrite").option("header", True).csv(path)
